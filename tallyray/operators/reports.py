"""Reports over state tables: filters, joins with reserves, top-k, systematic
samples, reconciliation with expected balances and drift diagnosis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import uint256 as u256
from ..functions.words import D38
from .joins import dim_join

KEY = ["user_address", "asset_address"]
TOLERANCE = 5
DUST = 5


def positions_with_tokens(positions: DataFrame, reserves: DataFrame) -> DataFrame:
    tok = reserves.select("asset_address", "atoken_address", "v_debt_token_address")
    return dim_join(positions, tok, "asset_address", "inner")


def _above(df: DataFrame, column: str, least: int) -> Column:
    """Whether an amount exceeds a small number; one without a decimal has over 38 digits, so its sign decides."""
    over = F.col(column) > least
    return F.coalesce(over, ~F.col("exact")[column].startswith("-")) if "exact" in df.columns else over


def nonzero_positions(df: DataFrame) -> DataFrame:
    return above_dust(df, 0)


def above_dust(df: DataFrame, dust: int = DUST) -> DataFrame:
    return df.where(_above(df, "scaled_atoken_balance", dust) | _above(df, "scaled_variable_debt", dust))


def changed_after(df: DataFrame, min_block: int) -> DataFrame:
    return df.where((F.col("last_updated_block") > min_block)
                    & (F.col("last_updated_block") > F.col("created_at_block")))


def snapshot_only(df: DataFrame) -> DataFrame:
    return df.where((F.col("created_at_block") == F.col("last_updated_block"))
                    & (F.col("last_updated_log_index") == -1))


def lookup_keys(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``table`` for a whole key table at once (semi join)."""
    return table.join(keys.select(*on).distinct(), list(on), "left_semi")


def oldest(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """Top-k by ``order`` (TakeOrderedAndProject: per-partition top-k, then merge)."""
    return df.orderBy(*order).limit(n)


def global_row_number(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Exact 1-based rank in ``order`` without a single-partition window.

    Range-partition and sort, number rows inside each partition, compute each
    partition's offset from the (tiny) per-partition counts, add.  The sorted
    data is checkpointed to the shared checkpoint folder first so both passes
    see the same partitioning and survive executor loss.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_df = df.repartitionByRange(n, *order).sortWithinPartitions(*order) \
        .withColumn("__pid", F.spark_partition_id()) \
        .withColumn("__mid", F.monotonically_increasing_id())
    from ..session import reliable_checkpoint
    stable = reliable_checkpoint(sorted_df)
    counts = stable.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"),
                                         F.min("__mid").alias("__first"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    # ``offs`` has one row per partition (bounded by ``n``): broadcast is safe.
    j = stable.join(F.broadcast(offs.select("__pid", "__off", "__first")), "__pid")
    return j.withColumn("rn", (F.col("__off") + F.col("__mid") - F.col("__first") + 1).cast("bigint")) \
        .drop("__pid", "__mid", "__off", "__first")


def systematic_sample(df: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    """Every step-th row in ``order`` (step = max(n // k, 1)), the first k of them."""
    ranked = global_row_number(df, order)
    total = ranked.count()
    step = max(total // k, 1)
    return ranked.where(((F.col("rn") - 1) % step == 0) & (F.col("rn") <= step * (k - 1) + 1)) \
        .drop("rn")


COMPARED = ("computed_supply", "computed_debt", "expected_supply", "expected_debt", "diff_supply", "diff_debt")


def reconcile(computed: DataFrame, expected: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Computed vs expected scaled balances per (user, asset); missing = 0.

    Rows with an amount beyond 38 digits have their exact texts in ``exact``;
    their differences are taken on limbs.
    """
    from .positions import exact_texts
    names = (("supply", "scaled_atoken_balance"), ("debt", "scaled_variable_debt"))
    side = lambda df, who: exact_texts(df).select(*KEY, *[F.col(c).alias(f"{who}_{s}") for s, c in names])
    j = side(computed, "computed").join(side(expected, "expected"), KEY, "full_outer")
    for c in COMPARED[:4]:
        j = j.withColumn(c, F.coalesce(F.col(c), F.lit("0")))
    for s, _ in names:
        a, b = F.col(f"computed_{s}"), F.col(f"expected_{s}")
        fits = (F.length(a) < 38) & (F.length(b) < 38)
        j = j.withColumn(f"__fits_{s}", fits)
        j = j.withColumn(f"diff_{s}", F.when(fits, F.abs(a.cast(D38) - b.cast(D38)).cast("string")).otherwise(
            u256.text(u256.magnitude(u256.total((1, u256.of_text(a)), (-1, u256.of_text(b)))))))
    close = lambda s: (F.length(f"diff_{s}") < 10) & (F.col(f"diff_{s}").try_cast("bigint") <= tolerance)
    wide = ~(F.col("__fits_supply") & F.col("__fits_debt"))
    return j.select(*KEY, *[F.col(c).try_cast(D38).alias(c) for c in COMPARED],
                    F.coalesce(close("supply") & close("debt"), F.lit(False)).alias("within_tolerance"),
                    F.when(wide, F.struct(*COMPARED)).alias("exact"))


def pass_fail_summary(rec: DataFrame) -> DataFrame:
    return rec.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum(F.when(F.col("within_tolerance"), 1).otherwise(0)).cast("bigint").alias("n_pass"),
        F.sum(F.when(~F.col("within_tolerance"), 1).otherwise(0)).cast("bigint").alias("n_fail"),
        F.sum(F.when(_above(rec, "diff_supply", 0), 1).otherwise(0)).cast("bigint").alias("n_supply_diff"),
        F.sum(F.when(_above(rec, "diff_debt", 0), 1).otherwise(0)).cast("bigint").alias("n_debt_diff"))


def classify_drift(diff: Column, diff_at_created: Column, diff_at_updated: Column) -> Column:
    """Where a mismatch comes from: already present at the creation block
    (the seed), arisen later (the replay), or within tolerance."""
    return (F.when(diff_at_created == diff, F.lit("at_creation"))
            .when(diff_at_updated != diff, F.lit("after_creation"))
            .otherwise(F.lit("within_tolerance")))
