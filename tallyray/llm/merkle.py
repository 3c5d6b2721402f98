"""A Merkle manifest of a table of documents, with a proof for every row.

Method: content-addressed descent.  Every row is a leaf, the sha256 of its
fields; the leaves of a source form a tree of runs of ``ARITY``, and the roots
of the sources form another.  Each inner node is kept as a record from its
digest to the digests of its children.  Requests for leaves start together at
the root: at every height each requested prefix of rank digits looks up the
record of its digest, steps to the child its next digit names and collects the
children it passes by as a path segment.  All leaves below a node share its
segments, so the descent handles each node once, not once per leaf.  Reversed,
the segments are the proof from leaf to root.

Scale: texts are hashed where they are read and are not shuffled.  Ranks come
from range partitions (a source may be a third of all rows: it spans many of
them) and a window over one row per (source, partition).  A tree level groups
runs of at most ``ARITY`` rows.  The loops run over heights (9 for 10^10 leaves);
only counts of levels, the one root and a row per source reach the driver.

Defined results: a null field counts as ``-``; a row without doc_id is first in
its source and never tampered with; rows with equal doc_id are ordered by leaf;
equal rows are leaves of their own; a null source is a source of its own, the
first; a lone leaf is its source's subroot, a lone subroot the root; an empty
table has no rows.  Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SEGMENT = "struct<left:string,right:string>"


@dataclass(frozen=True)
class Tree:
    """records[h - 1]: (digest, children) of the nodes of height h, without repeats; tops: (grp, digest, height)."""

    records: list[DataFrame]
    tops: DataFrame


@dataclass(frozen=True)
class Manifest:
    """runs: (grp, idx, total, digest, leaves) of the first height; a source's grp orders null first."""

    runs: DataFrame
    rows: Tree
    sources: Tree
    ordinals: DataFrame  # (grp, ordinal) of the sources
    root: str | None


def digest_of(fields: dict[str, Column]) -> Column:
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(fields[f]) for f in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, grp, leaf, tampered (the leaf of the tampered row; null where a row is not tampered with), n."""
    fields = {f: F.col(f"`{f}`") for f in FIELDS}
    changed = {**fields, "text": F.translate(fields["text"], UPPER, LOWER)}
    hit = F.crc32(F.encode(fields["doc_id"].cast("string"), "utf-8")) % 5 == 0
    return docs.select(fields["doc_id"].cast("long").alias("doc_id"),
                       F.coalesce(F.concat(F.lit("s"), fields["source"]), F.lit("")).alias("grp"),
                       digest_of(fields).alias("leaf"), F.when(hit, digest_of(changed)).alias("tampered"),
                       F.monotonically_increasing_id().alias("n"))


def ranked(rows: DataFrame, grp: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place in its group from 0, and ``total``, the group's rows; (grp, *order) names a row."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(parts, grp, *order).withColumn("slice", F.spark_partition_id()))
    own = Window.partitionBy(grp)
    starts = dealt.groupBy(grp, "slice").agg(F.count("*").alias("part")).select(
        grp, "slice", (F.sum("part").over(own.orderBy("slice")) - F.col("part")).alias("start"), F.sum("part").over(own).alias("total"))
    place = F.row_number().over(Window.partitionBy(grp, "slice").orderBy(*order)) - 1
    return dealt.join(starts, [grp, "slice"]).withColumn("idx", F.col("start") + place).drop("slice", "start")


def above(total: str) -> Column:
    return F.expr(f"({total} + {ARITY - 1}) div {ARITY}")


def node(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def raised(level: DataFrame) -> DataFrame:
    """The level above the rows (grp, idx, total, digest) of unfinished groups, with the children of each node."""
    runs = level.groupBy("grp", F.expr(f"idx div {ARITY}").alias("idx")).agg(
        F.first(above("total")).alias("total"), F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))
    children = F.col("run.digest")
    return runs.select("grp", "idx", "total", node(children).alias("digest"), children.alias("children"))


def grown(level: DataFrame, height: int) -> Tree:
    """The trees over ``level`` (grp, idx, total, digest[, children]), whose nodes have the given height."""
    records, tops = [], []
    while True:
        if "children" in level.columns:
            records.append(level.where("children is not null").select("digest", "children").dropDuplicates(["digest"]))
        tops.append(level.where("total = 1").select("grp", "digest", F.lit(height).alias("height")))
        rest = level.where("total > 1").select("grp", "idx", "total", "digest")
        if rest.isEmpty():
            break
        level, height = stored(raised(rest)), height + 1
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return Tree(records, top)


def manifest(docs: DataFrame) -> Manifest:
    ordered = ranked(stored(leaves(docs)), "grp", ["doc_id", "leaf", "n"])
    runs = ordered.groupBy("grp", F.expr(f"idx div {ARITY}").alias("idx")).agg(
        F.first("total").alias("leaves_total"), F.sort_array(F.collect_list(F.struct("idx", "doc_id", "leaf", "tampered"))).alias("leaves"))
    lone = F.col("leaves_total") == 1
    runs = stored(runs.select("grp", "idx", above("leaves_total").alias("total"), "leaves",
                              F.when(lone, F.col("leaves.leaf")[0]).otherwise(node(F.col("leaves.leaf"))).alias("digest"),
                              F.when(lone, 0).otherwise(1).alias("height")))
    # The runs are the records of height 1: they hold their leaves themselves.
    rows = grown(runs.select("grp", "idx", "total", "digest"), 1)
    tops = stored(rows.tops.join(runs.where("height = 0").select("grp", F.col("height").alias("lone")), "grp", "left")
                  .select("grp", "digest", F.coalesce("lone", "height").alias("height")))
    ordinals = stored(ranked(tops.withColumn("all", F.lit(0)), "all", ["grp"]).select("grp", "digest", "height", "idx", "total"))
    sources = grown(ordinals.select(F.lit("").alias("grp"), "idx", "total", "digest"), 0)
    found = sources.tops.select("digest").head()
    return Manifest(runs, Tree(rows.records, tops), sources, ordinals.select("grp", F.col("idx").alias("ordinal")), found and found[0])


def descended(tree: Tree, at: DataFrame, heights: dict[int, DataFrame], wanted: DataFrame | None, least: int) -> DataFrame:
    """(grp, idx, digest, path) of the requested nodes of height ``least``.

    at: (grp, digest, height, path) of the groups' roots.  ``heights`` maps a height to its records;
    wanted: (grp, idx) of requested leaves, None for all.

    Its joins are never broadcast: the planner does not see that a node has ``ARITY`` children and how long paths are,
    takes a front for some hundred times smaller than it is and would gather it in the driver.
    """
    front = None
    for h in range(max(heights, default=least), least, -1):
        here = at.where(F.col("height") == h).select("grp", F.lit(0).cast("long").alias("idx"), "digest", "path")
        here = here if front is None else front.unionByName(here)
        kids = here.join(heights[h].hint("merge"), "digest").select("grp", "idx", "path", "children", F.posexplode("children").alias("digit", "child"))
        left = F.array_join(F.slice("children", F.lit(1), F.col("digit")), "")
        right = F.array_join(F.slice("children", F.col("digit") + 2, F.lit(ARITY)), "")
        front = kids.select("grp", (F.col("idx") * ARITY + F.col("digit")).alias("idx"), F.col("child").alias("digest"),
                            F.concat("path", F.array(F.struct(left.alias("left"), right.alias("right")))).alias("path"))
        if wanted is not None:
            front = front.join(wanted.select("grp", F.expr(f"idx div {ARITY ** (h - 1)}").alias("idx")).distinct().hint("merge"), ["grp", "idx"], "left_semi")
    here = at.where(F.col("height") <= least).select("grp", F.lit(0).cast("long").alias("idx"), "digest", "path")
    return here if front is None else front.unionByName(here)


def proofs(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """doc_id, leaf, tampered, subroot, path (from leaf to root) of the leaves whose doc_id is in ``requests`` (doc_id),
    None for every leaf."""
    wanted = None
    if requests is not None:
        ids = requests.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        wanted = stored(m.runs.select("grp", F.explode("leaves").alias("l")).select("grp", "l.idx", "l.doc_id")
                        .join(ids, "doc_id", "left_semi").select("grp", "idx"))
    empty = F.array().cast(f"array<{SEGMENT}>")
    start = m.sources.tops.select("grp", "digest", "height", empty.alias("path"))
    some = None if wanted is None else m.ordinals.join(wanted.select("grp").distinct(), "grp", "left_semi") \
        .select(F.lit("").alias("grp"), F.col("ordinal").alias("idx"))
    subs = descended(m.sources, start, dict(enumerate(m.sources.records, 1)), some, 0)
    subs = subs.select(F.col("idx").alias("ordinal"), F.col("digest").alias("subroot"), "path").join(m.ordinals.hint("merge"), "ordinal")
    if wanted is not None:
        subs = subs.join(wanted.select("grp").distinct(), "grp", "left_semi")
    at = stored(subs.join(m.rows.tops.select("grp", "height").hint("merge"), "grp").select("grp", F.col("subroot").alias("digest"), "height", "path"))
    front = descended(m.rows, at, dict(enumerate(m.rows.records, 2)), wanted, 1)
    # Height 1: the record of a run is the run, looked up by its digest and place.
    runs = m.runs.join(front.hint("merge"), ["grp", "idx", "digest"])
    left = F.array_join(F.slice("all", F.lit(1), F.col("digit")), "")
    right = F.array_join(F.slice("all", F.col("digit") + 2, F.lit(ARITY)), "")
    own = F.when(F.col("height") == 1, F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(empty)
    found = runs.select("grp", "path", "height", F.col("leaves.leaf").alias("all"), F.posexplode("leaves").alias("digit", "l"))
    found = found.select("grp", F.col("l.idx").alias("idx"), F.col("l.doc_id").alias("doc_id"), F.col("l.leaf").alias("leaf"),
                         F.col("l.tampered").alias("tampered"), F.reverse(F.concat("path", own)).alias("path"))
    if wanted is not None:
        found = found.join(wanted.hint("merge"), ["grp", "idx"], "left_semi")
    return found.join(at.select("grp", F.col("digest").alias("subroot")), "grp").select("doc_id", "leaf", "tampered", "subroot", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the path of its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def verified(docs: DataFrame) -> DataFrame:
    """Every document's proof, checked against its (possibly tampered) row."""
    m = manifest(docs)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return (proofs(m).withColumn("root", F.lit(m.root).cast("string"))
            .withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
            .select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))
