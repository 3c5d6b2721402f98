"""A corpus pipeline over ``documents``: clean, deduplicate, mix, tokenize.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared checkpoint folder and rereads it as the next
stage's ``docs``.  All stages but the last return the columns of documents.
Null, empty and repeated rows are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyray.llm import bpe, line_dedup, mixing, quality_rules, weighted_minhash
from tallyray.llm.common import stored, table
from tallyray.llm.queries import tokenizer


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines and rejected documents go."""
    return quality_rules.kept_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines spread over many sites stay only where they are first."""
    return line_dedup.deduped_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return weighted_minhash.representatives(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mixture takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, source, text, n_tokens, ids, round_trip."""
    return bpe.encoded_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("bpe", encode),
]

# SQL cannot express byte-pair merges or weighted sampling.  tests/llm holds the
# rows of quality_rules and line_dedup (its operator) against brute force, and
# checks planted cases of the other stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
