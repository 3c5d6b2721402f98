"""Address columns: canonical lower-case hex keys, validation, checksum text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keccak import checksum

ZERO_ADDRESS = "0x" + "0" * 40
ADDRESS_RE = "^0x[0-9a-f]{40}$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def address_of(n) -> Column:
    """Integral id -> a synthetic 20-byte address (used by the fixture adapters)."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(_c(n).cast("bigint"))), 40, "0"))


def normalize_address(x) -> Column:
    """trim + lower-case; null when the text is not a 20-byte hex address."""
    v = F.lower(F.trim(_c(x)))
    return F.when(v.rlike(ADDRESS_RE), v)


def is_zero_address(x) -> Column:
    return _c(x) == F.lit(ZERO_ADDRESS)


@F.pandas_udf(T.StringType())
def _checksum_udf(addrs: pd.Series) -> pd.Series:
    return addrs.map(checksum)


def with_checksum(df: DataFrame, col: str, out: str = None) -> DataFrame:
    """Add the mixed-case checksum text of ``col``.

    Keccak is computed once per *distinct* address (a hash aggregate with
    map-side combine), then joined back on the lower-case key, so the Python
    work grows with the number of addresses, not with the number of rows.
    """
    out = out or f"{col}_checksum"
    keys = df.select(F.col(col).alias("__addr")).where(F.col("__addr").isNotNull()).distinct()
    cs = keys.select("__addr", _checksum_udf(F.col("__addr")).alias(out))
    return df.join(cs, df[col] == cs["__addr"], "left").drop("__addr")
