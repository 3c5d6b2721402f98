"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyray.session import checkpoint_dir

# The word of every contract: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


# Rows of an Arrow batch handed to Python.  Texts are long: the default of
# 10,000 rows makes each worker hold tens of MB several times over.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_ROWS`` rows; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    """Words (``WORD``) of a text as a long; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder and read
    back: cuts the lineage, and every later read sees the same rows even after
    executors were lost."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_narrow(df: DataFrame) -> DataFrame:
    """``stored`` for tables of ids: in at most an eighth as many files as the
    session has shuffle partitions, but two per core.

    Their rows are a few numbers each, so that one task can write some shuffle
    partitions one after the other; a file per partition costs more than the rows.
    """
    spark = df.sparkSession
    most = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    return stored(df.coalesce(most))


def order_hash(seed: str, key: Column) -> Column:
    """A seeded pseudo-random order of rows by key: 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))


def bucket_starts(rows: DataFrame, group: str, bucket: str, amount: str) -> DataFrame:
    """Per (group, bucket): ``start``, the amount in the group's earlier buckets, and ``total``, the group's amount.

    Buckets are a bounded number of slices of an order; the window below sees
    one row per bucket of a group, however many rows the group has.
    """
    parts = rows.groupBy(group, bucket).agg(F.sum(amount).alias("part"))
    own = Window.partitionBy(group)
    return parts.select(group, bucket, (F.sum("part").over(own.orderBy(bucket)) - F.col("part")).alias("start"),
                        F.sum("part").over(own).alias("total"))


def before(group: str, bucket: str, amount: str, order: list[Column]) -> Column:
    """What lies before a row inside its (group, bucket), in that order."""
    w = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(w), F.lit(0))
