"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources (by code point, null last) weigh 1, 2, 3, repeating, and share all
words by weight; a target stops at ``max_passes`` times its source's size and
the excess is shared again by weight.  With the sources in the order of cap
over weight, the capped ones are a prefix, so the level at which no target is
above its cap comes from running sums instead of a loop.

The words are dealt in equal blocks.  Blocks are allotted to sources by the
highest quotients target / (2k + 1); house sizes that grow shard by shard give
each shard its integer quota per source.  At a house of H blocks a source's
seats differ from its fair share q by at most q * n / 2H + 1/2 (n sources), so
only the seats inside that band are ranked: about 3n quotients, not H.

Each source's documents lie in a seeded order that is cut into one region per
shard, as wide as the shard's share of the source's blocks, so that every
region is taken as often as its source.  From its region a shard takes its
quota: whole passes and, for the rest, the blocks that follow a block seeded by
(source, shard), around the region's end.  What a document gives is the overlap
of its words with those blocks, and its shard is the one that takes most of it.
Word counts are summed inside slices of the seeded order, so no source is ever
one task.

Built with DataFrame functions only.  Defined results: null and empty texts
have size 0 and give nothing; null ids are ordered as the text 'null', rows of
one id by their texts; equal rows share their order; a table without words has
targets 0; a document of which nothing is taken has no shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import before, bucket_starts, order_hash, stored, word_count

BLOCK_WORDS = 32
SHARDS = 8
MAX_PASSES = 3


def _base(docs: DataFrame, row: Column, seed: str) -> DataFrame:
    # the text is part of the order: rows without id, or of one id, spread over the slices
    h = order_hash(seed, F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.xxhash64("text").cast("string")))
    return docs.select(row.alias("row"), F.col("source").alias("source"),
                       F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null")).alias("skey"),
                       word_count(F.col("text")).alias("size"), h.alias("h"), F.substring(h, 1, 3).alias("slice"),
                       F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tie"))


def targets(rows: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    """skey, place, weight, source_size, target, words, sources: one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    sources = (rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
               .withColumn("place", F.row_number().over(by_name))
               .withColumn("weight", (F.col("place") - 1) % 3 + 1)
               .withColumn("cap", F.col("source_size") * max_passes)
               .withColumn("words", F.sum("source_size").over(everything))
               .withColumn("sources", F.count("*").over(everything)))
    upward = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("place"))
    level = (F.col("words") - (F.sum("cap").over(upward) - F.col("cap"))) / \
        (F.sum("weight").over(everything) - F.sum("weight").over(upward) + F.col("weight"))
    return (sources.withColumn("own_level", level)
            .withColumn("level", F.min_by("own_level", F.struct(F.col("cap") / F.col("weight"), "place"))
                        .over(Window.partitionBy(F.col("cap") / F.col("weight") <= F.col("own_level"))))
            .withColumn("target", F.when(F.col("cap") / F.col("weight") <= F.col("own_level"), F.col("cap").cast("double"))
                        .otherwise(F.col("level") * F.col("weight")))
            .select("skey", "source", "place", "weight", "source_size", "target", "words", "sources"))


def quotas(sources: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """Blocks of each source in each shard: skey, shard, quota; and ``blocks``, the blocks of all."""
    houses = (sources.where("target > 0")
              .withColumn("blocks", F.greatest(F.expr(f"words div {block_words}"), F.lit(1)))
              .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
              .withColumn("house", F.expr(f"blocks * (shard + 1) div {shards}")).where("house > 0"))
    fair = F.col("house") * F.col("target") / F.col("words")
    sway = fair * F.col("sources") / (2 * F.col("house"))
    band = (houses.withColumn("low", F.greatest(F.floor(fair - sway - 0.5), F.lit(0)))
            .withColumn("high", F.ceil(fair + sway + 0.5))
            .withColumn("sure", F.sum("low").over(Window.partitionBy("shard"))))
    ranked = (band.withColumn("k", F.explode(F.sequence(F.col("low"), F.col("high"))))
              .withColumn("turn", F.row_number().over(Window.partitionBy("shard").orderBy(
                  (F.col("target") / (2 * F.col("k") + 1)).desc(), F.col("place")))))
    seats = (ranked.groupBy("skey", "shard", "blocks", "low")
             .agg(F.sum((F.col("turn") <= F.col("house") - F.col("sure")).cast("long")).alias("more"))
             .withColumn("seats", F.col("low") + F.col("more")))
    earlier = F.coalesce(F.lag("seats").over(Window.partitionBy("skey").orderBy("shard")), F.lit(0))
    return seats.select("skey", "shard", "blocks", (F.col("seats") - earlier).alias("quota"))


def _overlap(a: Column, b: Column) -> Column:
    """Words of the document [at, at + size) inside [a, b)."""
    return F.greatest(F.least(F.col("at") + F.col("size"), b) - F.greatest(F.col("at"), a), F.lit(0))


def runs(sources: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, max_passes: int = MAX_PASSES,
         seed: str = "mix") -> DataFrame:
    """What each shard takes of each source's seeded order: skey, shard, low, high (its region), passes, first, rest
    (the run of ``rest`` words from ``first`` on, around the region's end)."""
    q = quotas(sources, block_words, shards).join(sources.select("skey", "source_size", "words"), "skey")
    own = Window.partitionBy("skey")
    q = (q.withColumn("upto", F.sum("quota").over(own.orderBy("shard"))).withColumn("all", F.sum("quota").over(own))
         .where(F.col("all") > 0)
         .withColumn("amount", F.least(F.round(F.col("all") * F.col("words") / F.col("blocks")).cast("long"),
                                       F.col("source_size") * max_passes))
         .withColumn("passes", F.expr("amount div source_size"))
         .withColumn("extra", F.col("amount") - F.col("passes") * F.col("source_size")))

    def cut(whole: str, seats: str) -> Column:
        return F.expr(f"cast(cast({whole} as decimal(38,0)) * ({seats}) div all as bigint)")

    block = F.col("words") / F.col("blocks")
    start = F.conv(F.substring(order_hash(f"{seed}-blocks", F.concat("skey", F.lit(":"), F.col("shard").cast("string"))), 1, 12), 16, 10).cast("long")
    q = (q.withColumn("low", cut("source_size", "upto - quota")).withColumn("high", cut("source_size", "upto"))
         .withColumn("rest", F.least(cut("extra", "upto") - cut("extra", "upto - quota"), F.col("high") - F.col("low"))))
    skip = F.pmod(start, F.greatest(F.floor((F.col("high") - F.col("low")) / block), F.lit(1)))
    return q.select("skey", "shard", "low", "high", "passes", (F.col("low") + F.floor(skip * block)).alias("first"), "rest")


def _taken(rows: DataFrame, block_words: int, shards: int, max_passes: int, seed: str) -> DataFrame:
    """The rows with source_size, target, taken and shard."""
    sources = stored(targets(rows, max_passes))
    # one array of ``shards`` regions a source
    regions = (runs(sources, block_words, shards, max_passes, seed).groupBy("skey")
               .agg(F.sort_array(F.collect_list(F.struct("shard", "low", "high", "passes", "first", "rest"))).alias("regions")))
    plan = sources.select("skey", "source_size", "target").join(regions, "skey", "left")
    starts = bucket_starts(rows, "skey", "slice", "size").drop("total").join(plan, "skey")
    order = [F.col("h"), F.col("size"), F.col("tie")]

    def share(r: Column) -> Column:
        end = r["first"] + r["rest"]
        return (r["passes"] * _overlap(r["low"], r["high"]) + _overlap(r["first"], F.least(end, r["high"]))
                + _overlap(r["low"], r["low"] + end - r["high"])).cast("long")

    most = F.array_max("shares")
    return (rows.join(starts, ["skey", "slice"])
            .withColumn("at", F.col("start") + before("skey", "slice", "size", order))
            .withColumn("shares", F.coalesce(F.transform("regions", share), F.array().cast("array<bigint>")))
            .withColumn("taken", F.aggregate("shares", F.lit(0).cast("long"), lambda a, x: a + x))
            .withColumn("shard", F.when(F.col("taken") > 0, F.element_at("regions", F.array_position("shares", most).cast("int"))["shard"])))


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, max_passes: int = MAX_PASSES,
          seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken and shard of every document."""
    rows = stored(_base(docs, F.struct("doc_id"), seed))
    return _taken(rows, block_words, shards, max_passes, seed).select("row.doc_id", "size", "source_size", "target", "taken", "shard")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, max_passes: int = MAX_PASSES,
                    seed: str = "mix") -> DataFrame:
    """Pipeline form: each document as often as the mix takes it.

    Only the documents at the ends of a run or region are taken in part;
    they stay if at least half of their words are taken.
    """
    rows = _base(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), seed)
    copies = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    return (_taken(rows, block_words, shards, max_passes, seed).where("taken > 0")
            .select("row", F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"))
            .select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))
