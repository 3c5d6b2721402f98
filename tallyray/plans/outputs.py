"""Result presentation: amounts become exact decimal text, whatever their size;
configuration values that are bounded by the inputs become BIGINT (a cast that
overflows raises in ANSI mode instead of wrapping)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.positions import exact_texts


def present(df: DataFrame, bigint: tuple[str, ...] = (), text: tuple[str, ...] = ()) -> DataFrame:
    cols = []
    for c in df.columns:
        if c in bigint:
            cols.append(F.col(c).cast("bigint").alias(c))
        elif c in text:
            cols.append(F.col(c).cast("string").alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def present_positions(df: DataFrame) -> DataFrame:
    return exact_texts(df)


def present_exact(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` as text: the exact text of wide rows, else the decimal's."""
    def shown(c: str):
        own = F.col(c).cast("string")
        return F.coalesce(F.col("exact")[c], own) if "exact" in df.columns else own

    return df.select(*[shown(c).alias(c) if c in columns else F.col(c) for c in df.columns if c != "exact"])
