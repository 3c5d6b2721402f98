"""Readers for the parquet input tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# Tables whose rows feed per-row heavy work (decode, ray maths, dedup sorts).
WIDE_WORK = {"lineitem", "events", "orders"}


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than the session has
    cores (a single large file / row group) so per-row work runs in parallel.

    Multi-file inputs already scan with at least that many splits and are
    returned unchanged, so at cluster scale this adds no shuffle.
    """
    spark = df.sparkSession
    par = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazily read one table; column pruning and filters reach the scan."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if name in WIDE_WORK else df
