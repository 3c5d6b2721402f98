"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, lexical_search, line_dedup, merkle, mixing, ngram_join, quality_classifier, quality_rules, sharding, token_counts,
               topk_search, toxicity, weighted_minhash)
from .common import table


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file; the folder is a parameter."""
    folder = os.environ.get("TALLYRAY_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleaved(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduped(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.classes(table(spark, sf_dir, "documents"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_sharding, op3_toxicity, op4_token_counts, op5_topk, op6_quality_rules,
                                   op7_mixing, op8_quality_classifier, op9_line_dedup, op10_minhash, op11_ngram_join,
                                   op12_lexical_search, op13_merkle)}



def merkle_sql(row_levels: int, source_levels: int) -> str:
    """The manifest level by level, for at most 16 ** row_levels rows a source and 16 ** source_levels sources."""

    def field(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def level(name: str, k: int) -> list[str]:
        run = "PARTITION BY grp, i // 16 ORDER BY i ROWS BETWEEN"
        return [f"""{name}s{k} AS (
  SELECT grp, i, node, count(*) OVER (PARTITION BY grp) AS n,
         coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{k})""", f"""{name}{k + 1} AS (
  SELECT grp, i // 16 AS i, CASE WHEN n > 1 THEN sha256(string_agg(node, '' ORDER BY i)) ELSE min(node) END AS node
  FROM {name}s{k} GROUP BY grp, i // 16, n)"""]

    steps = [x for k in range(row_levels) for x in level("a", k)]
    steps.append(f"b0 AS (SELECT 0 AS grp, row_number() OVER (ORDER BY grp) - 1 AS i, grp AS source, node FROM a{row_levels})")
    steps += [x for k in range(source_levels) for x in level("b", k)]
    levels = [f"a{k}" for k in range(row_levels)] + [f"b{k}" for k in range(source_levels)]
    fold = "coalesce(x.tampered, x.leaf)"
    for v in levels:
        fold = f"CASE WHEN {v}.n > 1 THEN sha256({v}.l || {fold} || {v}.r) ELSE {fold} END"
    joins = [f"JOIN as{k} a{k} ON a{k}.grp = x.grp AND a{k}.i = x.i // {16 ** k}" for k in range(row_levels)]
    joins.append("JOIN b0 top ON top.source = x.grp")
    joins += [f"JOIN bs{k} b{k} ON b{k}.i = top.i // {16 ** k}" for k in range(source_levels)]
    proof = " || ".join(f"{v}.l || {v}.r" for v in levels)
    crc = """list_reduce([4294967295::BIGINT] || flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]
      FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
      lambda s, v: CASE WHEN v >= 0 THEN xor(s, v) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384::BIGINT) ELSE s // 2 END)"""
    return f"""
WITH h AS (
  SELECT doc_id, coalesce('s' || source, '') AS grp, {leaf("text")} AS leaf,
         CASE WHEN xor({crc}, 4294967295::BIGINT) % 5 = 0
              THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
  FROM documents),
x AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM h),
a0 AS (SELECT grp, i, leaf AS node FROM x),
{(", " + chr(10)).join(steps)},
f AS (
  SELECT x.doc_id, x.leaf, top.node AS subroot, b{source_levels}.node AS root, sha256({proof}) AS proof_sha256, {fold} AS folded_root
  FROM x {" ".join(joins)} JOIN b{source_levels} ON b{source_levels}.i = 0)
SELECT *, folded_root = root AS verified FROM f
"""


SQL = {
    "op5_topk": """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.vec, c.vec)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)
  WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
""",
    "op9_line_dedup": r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS t FROM l),
b AS (
  SELECT t, min(doc_id) AS first FROM n
  WHERE length(t) >= 20 AND regexp_matches(t, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]')
  GROUP BY t HAVING count(DISTINCT coalesce('s:' || source, 'null')) >= 3),
m AS (
  SELECT n.doc_id, n.i, n.line, b.first IS NOT NULL AND NOT coalesce(n.doc_id = b.first
         AND row_number() OVER (PARTITION BY n.doc_id, n.t ORDER BY n.i) = 1, false) AS gone
  FROM n LEFT JOIN b ON n.t = b.t)
SELECT d.doc_id, coalesce(x.n_lines, 0) AS n_lines, coalesce(x.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(x.clean_text, '') END AS clean_text
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS BIGINT)) AS BIGINT) AS n_removed,
         string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS clean_text
  FROM m GROUP BY doc_id) x USING (doc_id)
""",
    "op12_lexical_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM documents),
c AS (SELECT count(DISTINCT row) AS nn, count(*) AS ll FROM d),
l AS (SELECT row, count(*) AS n FROM d GROUP BY row),
t AS (SELECT row, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term, nn),
q AS (
  SELECT DISTINCT item, item_id, term FROM (
    SELECT row_number() OVER () AS item, item_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
    FROM benchmark)),
s AS (
  SELECT item, item_id, row, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN l USING (row), c
  GROUP BY item, item_id, row, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
""",
    "op13_merkle": merkle_sql(row_levels=6, source_levels=3),
}
