"""Chain order: ordering keys, the strict guard, as-of lookups.

An *ordkey* is ``(block_number, log_index[, leg])`` compared lexicographically.
For aggregation it is packed into one ``decimal(38,0)``
(``block * 10^20 + (log_index + 1) * 10 + leg``); decimals are mutable
aggregation-buffer types, so ``max_by(value, ordkey)`` stays a hash aggregate
with map-side partial combine.  ``log_index = -1`` (snapshot rows) packs below
every real log of the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.words import D38, dlit

ORD_BLOCK = 10 ** 20


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ordkey(block="block_number", log="log_index", leg=None) -> Column:
    k = _c(block).cast(D38) * dlit(ORD_BLOCK) + (_c(log).cast(D38) + 1) * 10
    if leg is not None:
        k = k + (_c(leg) if not isinstance(leg, int) else F.lit(leg)).cast(D38)
    return k.cast(D38)


def ord_block(k) -> Column:
    k = _c(k)
    return ((k - F.pmod(k, dlit(ORD_BLOCK))) / dlit(ORD_BLOCK)).cast("bigint")


def ord_log(k) -> Column:
    k = _c(k)
    rest = F.pmod(k, dlit(ORD_BLOCK))
    return ((rest - F.pmod(rest, F.lit(10))) / 10 - 1).cast("bigint")


def guard_newer(stored_block, stored_log, block, log) -> Column:
    """The strict guard: the stored ordkey is older than the incoming one."""
    sb, sl, b, lg = _c(stored_block), _c(stored_log), _c(block), _c(log)
    return (sb < b) | ((sb == b) & (sl < lg))


def not_after(block, log, at_block: int, at_log: int) -> Column:
    """(block, log) <= (at_block, at_log)."""
    b, lg = _c(block), _c(log)
    return (b < at_block) | ((b == at_block) & (lg <= at_log))


def asof_join(probes: DataFrame, reads: DataFrame, key: str, value_cols: list[str],
              block: str = "block_number", log: str = "log_index",
              bucket_blocks: int = 10_000) -> DataFrame:
    """For each probe row, the latest read of the same key at or before its block.

    Reads at the probe's own block count (a read "at block N" is the state
    after block N).  Skew-safe form: time is cut into buckets of
    ``bucket_blocks``; inside each (key, bucket) a window carries the last
    read forward, and reads from earlier buckets come from a per-(key, bucket)
    ``max_by`` table (map-side combined) whose carry is a window over buckets
    only.  A hot key is therefore spread over its buckets, never one task.
    """
    bkt = F.floor(F.col(block) / bucket_blocks).cast("bigint")
    r = reads.select(F.col(key), F.col(block).alias("__b"), F.col(log).alias("__l"),
                     *[F.col(c) for c in value_cols]).withColumn("__bkt", F.floor(F.col("__b") / bucket_blocks).cast("bigint"))
    p_cols = [c for c in probes.columns]
    p = probes.withColumn("__bkt", bkt)
    # 1) within bucket: union probes and reads, carry the last read forward
    tagged_r = r.select(F.col(key), "__bkt", F.col("__b").alias("__ob"), F.lit(0).alias("__side"),
                        F.col("__l").alias("__ol"),
                        F.struct(*[F.col(c) for c in value_cols]).alias("__val"),
                        *[F.lit(None).cast(probes.schema[c].dataType).alias(c)
                          for c in p_cols if c not in (key,)])
    tagged_p = p.select(F.col(key), "__bkt", F.col(block).alias("__ob"), F.lit(1).alias("__side"),
                        F.lit(None).cast("bigint").alias("__ol"),
                        F.lit(None).cast(tagged_r.schema["__val"].dataType).alias("__val"),
                        *[F.col(c) for c in p_cols if c not in (key,)])
    u = tagged_r.unionByName(tagged_p)
    w = (Window.partitionBy(key, "__bkt").orderBy("__ob", "__side", "__ol")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = u.withColumn("__local", F.last("__val", ignorenulls=True).over(w)) \
        .where(F.col("__side") == 1)
    # 2) carry from earlier buckets: last read per (key, bucket) (map-side
    # combined), then a window over the buckets of each key.
    per_bkt = r.groupBy(key, "__bkt").agg(
        F.max_by(F.struct(*[F.col(c) for c in value_cols]),
                 F.col("__b").cast(D38) * dlit(ORD_BLOCK) + F.col("__l").cast(D38)).alias("__last"))
    probe_bkts = p.select(key, "__bkt").distinct()
    allb = probe_bkts.join(per_bkt, [key, "__bkt"], "full_outer")
    wb = Window.partitionBy(key).orderBy("__bkt").rowsBetween(Window.unboundedPreceding, -1)
    allb = allb.withColumn("__prev", F.last("__last", ignorenulls=True).over(wb)) \
        .select(key, "__bkt", "__prev")
    out = local.join(allb, [key, "__bkt"], "left") \
        .withColumn("__v", F.coalesce("__local", "__prev"))
    return out.select(F.col(key), *[F.col(c) for c in p_cols if c != key],
                      *[F.col("__v").getField(c).alias(c) for c in value_cols])
