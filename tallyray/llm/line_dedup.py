"""Removal of lines that spread over many sites.

A line counts if it has at least three words and 20 characters (blanks at its
ends set aside).  Lines are named by 128 bits of hashes.  Aggregation merges a
HyperLogLog sketch of the sites of every line straight from the lines, partial
sketches before the shuffle.  Lines estimated clearly above ``min_sites`` are
boilerplate, those clearly below are not; only those near the threshold get an
exact count of distinct sites.  Boilerplate stays where it is first (least
doc_id, first place there), so that no text is lost, and goes everywhere else.

The site is the document's source.  Built with DataFrame functions only.  The
names to look up are salted before they meet the lines, so that a very common
line is many tasks; what comes back to a document are the places of the lines
that go, taken from its places as a set: linear in its lines.

Defined results: a null text is left null and has no lines; an empty text has
one line; a null source is a site of its own; a null doc_id is never the first
place, and lines found only without ids stay; documents all of whose lines go
become empty texts, they are not dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MIN_SITES = 3
LG_K = 12
SALTS = 16
MIN_CHARS = 20
_BLANK, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
THREE_WORDS = _BLANK.join([_WORD] * 3)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _names(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit("line"), line)


def _counts(line: Column) -> Column:
    return (F.length(line) >= MIN_CHARS) & line.rlike(THREE_WORDS)


def counted_lines(docs: DataFrame) -> DataFrame:
    """The lines that count, with their places: id, th (names the text), site, place, l1, l2."""
    l1, l2 = _names(F.col("line"))
    # named before the lines are dealt out: a row of a line must not carry the whole text
    return (docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"),
                        F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null")).alias("site"),
                        F.transform(F.split("text", "\n", -1), _trimmed).alias("lines"))
            .select("id", "th", "site", F.posexplode("lines").alias("place", "line"))
            .where(_counts(F.col("line"))).select("id", "th", "site", "place", l1.alias("l1"), l2.alias("l2")))


def sketched(lines: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """l1, l2, sites (estimated by a HyperLogLog sketch of 2 ** lg_k registers), first (least id)."""
    return lines.groupBy("l1", "l2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"),
                                         F.min("id").alias("first"))


def margin(min_sites: int, lg_k: int) -> int:
    """Four standard errors of a sketch at ``min_sites``, one at least."""
    return max(1, round(4 * 1.04 / 2 ** (lg_k / 2) * min_sites))


def _salted(names: DataFrame) -> DataFrame:
    return names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def boilerplate_places(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """The lines found on at least ``min_sites`` sites: id, th, place, l1, l2, first."""
    m = margin(min_sites, lg_k)
    likely = stored(sketched(lines, lg_k).where(F.col("sites") >= min_sites - m)
                    .select("l1", "l2", "first", (F.col("sites") <= min_sites + m).alias("near")))
    salt = F.pmod(F.xxhash64("id", "th"), F.lit(SALTS)).cast("int")
    found = stored(lines.withColumn("salt", salt).join(_salted(likely), ["l1", "l2", "salt"]))
    exact = (found.where("near").groupBy("l1", "l2").agg(F.count_distinct("site").alias("n"))
             .where(F.col("n") >= min_sites).select("l1", "l2"))
    sure = found.where("not near").unionByName(found.where("near").join(_salted(exact), ["l1", "l2", "salt"], "left_semi"))
    return sure.select("id", "th", "place", "l1", "l2", "first")


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``docs`` as column ``row``, with ``lines`` (array), ``left`` (the lines that stay) of every document."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    bad = boilerplate_places(counted_lines(docs), min_sites, lg_k)
    # rows that repeat a document share their places: the set holds them once
    per_line = bad.groupBy("id", "th", "l1", "l2", "first").agg(F.collect_set("place").alias("places"))
    goes = (F.when(F.col("first") == F.col("id"), F.array_remove("places", F.array_min("places")))
            .when(~F.col("first").eqNullSafe(F.col("id")), F.col("places")))
    here = per_line.select("id", "th", F.explode(goes).alias("place")).groupBy("id", "th").agg(F.collect_list("place").alias("gone"))
    d = docs.select(row, F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("lines")).alias("d")
    h = here.alias("h")
    joined = (d.join(h, F.col("d.id").eqNullSafe(F.col("h.id")) & (F.col("d.th") == F.col("h.th")), "left")
              .select("row", "lines", "gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    left = F.transform(stay, lambda i: F.get(F.col("lines"), i))
    return joined.select("row", "lines", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(left).alias("left"))


def deduped(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed and clean_text of every document."""
    return (cleaned(docs.select("doc_id", "source", "text"), min_sites)
            .select("row.doc_id", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
                    F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long").alias("n_removed"),
                    F.array_join("left", "\n").alias("clean_text"))
            .withColumn("n_lines", F.when(F.col("clean_text").isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("long"))
            .withColumn("n_removed", F.when(F.col("clean_text").isNull(), F.lit(0)).otherwise(F.col("n_removed")).cast("long")))


def deduped_documents(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Pipeline form: the same columns, boilerplate lines removed from the texts."""
    gone = F.size("lines") > F.size("left")
    text = F.when(gone, F.array_join("left", "\n")).otherwise(F.col("row.text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(gone, F.length(text)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return cleaned(docs, min_sites).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
