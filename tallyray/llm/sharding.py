"""Sharding by proportional stratified interleaving.

Within each source the rows are put into a seeded random order; a row's
fractional rank is its place there, shifted by a seeded part of a step per
source, over the number of the source's rows.  Sorted by fractional rank, any
run of rows holds every source in its share, so the order is cut into shards
of consecutive rows whose counts differ by at most one.

Ranks are taken without sorting a source in one task: the seeded hash cuts
every source into 4,096 slices; ranks are counted inside slices, and slices
are offset by a table with one row per (source, slice).  The same is done for
the global order with slices of the fractional rank.  Only narrow rows move.

Law: ``rows``.  Defined results: null texts have size 1 and checksum 0; null
sources form a source of their own; null ids are ordered as the text 'null';
repeated rows are told apart only by their place; an empty table gives none.
Equal texts are not kept together: the method stratifies by source only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import before, bucket_starts, order_hash, stored, whole_text

SLICES = 4096
LAW = "rows"


def interleaved(docs: DataFrame, shards: int = 16, seed: str = "shards") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    text = whole_text(F.col("text"))
    rows = stored(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null")).alias("stratum"),
        order_hash(seed, F.col("doc_id")).alias("h"), F.lit(1).cast("long").alias("one")))
    rows = rows.withColumn("slice", F.substring("h", 1, 3))
    tie = [F.col("h"), F.col("size"), F.col("text_crc32"), F.col("doc_id")]
    shift = F.conv(F.substring(order_hash(seed, F.col("stratum")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    ranked = (rows.join(bucket_starts(rows, "stratum", "slice", "one"), ["stratum", "slice"])
              .withColumn("rank", F.col("start") + before("stratum", "slice", "one", tie))
              .select("doc_id", "size", "text_crc32", "stratum", "h", "one",
                      ((F.col("rank") + shift) / F.col("total")).alias("fraction"), F.lit(0).alias("all")))
    ranked = stored(ranked.withColumn("part", F.least(F.floor(F.col("fraction") * SLICES), F.lit(SLICES - 1)).cast("int")))
    starts = bucket_starts(ranked.withColumnRenamed("part", "slot_part"), "all", "slot_part", "one") \
        .withColumnRenamed("slot_part", "part")
    order = [F.col("fraction"), F.col("stratum"), *tie]
    placed = (ranked.join(starts, ["all", "part"])
              .withColumn("place", F.col("start") + before("all", "part", "one", order))
              .withColumn("shard", F.floor(F.col("place") * shards / F.col("total")).cast("int")))
    # The exact quotient, whatever the division of doubles above rounded to.
    first = lambda s: F.expr(f"({s} * total + {shards} - 1) div {shards}")
    return (placed.withColumn("shard", F.when(F.col("place") < first("shard"), F.col("shard") - 1)
                              .when(F.col("place") >= first("(shard + 1)"), F.col("shard") + 1).otherwise(F.col("shard")))
            .select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
                    (F.col("place") - first("shard")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
