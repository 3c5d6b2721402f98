"""The log scan: block range x tracked emitters x tracked topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import dim_join


def scan_logs(logs: DataFrame, lo: int, hi: int, addresses: DataFrame | None = None,
              topics: DataFrame | None = None, bucket_col: str = "block_bucket",
              bucket_blocks: int = 1000) -> DataFrame:
    """Logs with ``lo <= block <= hi``, emitted by a tracked address, whose
    topic0 is tracked.

    The range is also stated on the partition column (``block_bucket``), so
    the scan prunes partition folders and pushes the block predicate into
    the parquet reader; the address and topic sets are small dimensions joined
    by checked-size broadcast semi joins.
    """
    sel = logs.where(F.col("block_number").between(lo, hi))
    if bucket_col in logs.columns:
        sel = sel.where(F.col(bucket_col).between(lo // bucket_blocks, hi // bucket_blocks))
    sel = sel.withColumn("topic0", F.lower(F.get(F.col("topics"), 0)))
    if addresses is not None:
        sel = dim_join(sel, addresses.select("address"), "address", "left_semi")
    if topics is not None:
        sel = dim_join(sel, topics.select("topic0"), "topic0", "left_semi")
    return sel
