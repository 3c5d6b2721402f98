"""De-duplication of deliveries and the processed-events table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import tasks_for

KEY_BUCKETS = 2 ** 16
MOST_COPIES = 1_000_000  # a key with more copies is reduced where they are read


def delivery_tasks(df: DataFrame, keys: Sequence[str] = ("tx_hash", "log_index")) -> int | None:
    """How many tasks take the rows of ``df`` shuffled by ``keys``; None when a key may have too many copies for one.

    One pass over the keys counts the rows per bucket of the keys' hash: no key has more copies than the fullest bucket.
    """
    buckets = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    got = buckets.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    return None if (got.most or 0) > MOST_COPIES else tasks_for(got.rows or 0)


def first_delivery(df: DataFrame, keys: Sequence[str] = ("tx_hash", "log_index"),
                   order: Column | str | None = None, tasks: int | None = None) -> DataFrame:
    """Keep one row per key: the copy that sorts first by ``order`` (ties and
    a missing order fall back to the full row, so the choice never depends on
    arrival order).

    ``row_number() = 1`` over ``(keys)``: Spark plans a partial top-1 per key
    on the map side (WindowGroupLimit) before the shuffle, so copies of one key
    are reduced where they are read -- a log delivered a million times costs
    one row per map task, never a hot reduce partition.

    That sorts all rows where they are read.  With ``tasks`` (:func:`delivery_tasks`)
    they are shuffled first and sorted once, in as many tasks.
    """
    from pyspark.sql.window import Window
    keys = list(keys)
    payload = [c for c in df.columns if c not in keys]
    lead = [] if order is None else [(F.col(order) if isinstance(order, str) else order).asc()]
    tie = [F.col(c).asc() for c in payload if c != order and not _is_complex(df, c)]
    # the keys' hash leads them: a sort that begins with a number compares few keys as a whole
    w = Window.partitionBy("__hash", *keys).orderBy(*lead, *tie)
    spread = df if tasks is None else df.repartition(tasks, *keys)
    hashed = spread.withColumn("__hash", F.hash(*keys))
    return hashed.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn", "__hash")


def _is_complex(df: DataFrame, c: str) -> bool:
    from pyspark.sql import types as T
    return isinstance(df.schema[c].dataType, (T.MapType,))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Batch insert where existing rows win: ``existing UNION (incoming ANTI existing)``."""
    keys = list(keys)
    new = first_delivery(incoming, keys).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def new_deliveries(processed: DataFrame, incoming: DataFrame,
                   keys: Sequence[str] = ("tx_hash", "log_index")) -> DataFrame:
    """Incoming rows whose key is not in the processed-events table yet."""
    return incoming.join(processed.select(*keys), list(keys), "left_anti")


def delete_older_than(processed: DataFrame, before_block: int | Column,
                      block: str = "block_number") -> DataFrame:
    """Retention: drop processed events with ``block < before_block``."""
    b = F.lit(before_block) if isinstance(before_block, int) else before_block
    return processed.where(F.col(block) >= b)
