"""Cell means, standard errors, contrasts and counts. All are partial + final hash
aggregations, so a key that holds a large share of the rows is combined in the map
tasks before anything is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvewise.functions.columns import standard_error, total


def cell_means(df: DataFrame, keys: Sequence[str], ys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(y).alias(f"mean_{y}") for y in ys])


def mean_se(df: DataFrame, keys: Sequence[str], y: str, n: str | int = "valid") -> DataFrame:
    """Mean and standard error per cell; `n` names the divisor (see standard_error)."""
    return df.groupBy(*keys).agg(
        F.count(y).alias("n"),
        F.avg(y).alias("mean"),
        standard_error(F.col(y), n).alias("se"),
    )


def nested_mean_se(
    df: DataFrame, inner: Sequence[str], outer: Sequence[str], y: str, n: str | int = "rows"
) -> DataFrame:
    """Mean per individual, then mean and SE across individuals per cell."""
    per = df.groupBy(*dict.fromkeys([*outer, *inner])).agg(F.avg(y).alias(y))
    return mean_se(per, outer, y, n)


def nested_total_mean_se(
    df: DataFrame, inner: Sequence[str], outer: Sequence[str], y: str, n: str | int = "rows"
) -> DataFrame:
    """Total per individual (no value = 0), then mean and SE across individuals."""
    per = df.groupBy(*dict.fromkeys([*outer, *inner])).agg(total(F.col(y)).alias(y))
    return mean_se(per, outer, y, n)


def cell_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def replicate_audit(df: DataFrame, keys: Sequence[str], y: str, k: int) -> DataFrame:
    """Cells with exactly k non-missing values."""
    return df.groupBy(*keys).agg(F.count(y).alias("n")).where(F.col("n") == k)


def paired_contrast(
    df: DataFrame, keys: Sequence[str], factor: str, a, b, ys: Sequence[str]
) -> DataFrame:
    """Value at level b minus value at level a inside each group, levels named."""

    def at(level, y: str) -> Column:
        return F.max(F.when(F.col(factor) == F.lit(level), F.col(y)))

    return df.groupBy(*keys).agg(*[(at(b, y) - at(a, y)).alias(f"delta_{y}") for y in ys])


def interval_columns(df: DataFrame, mean: str = "mean", se: str = "se", z: float = 1.0) -> DataFrame:
    """mean - z se and mean + z se; z = 1 for error bars, 1.96 for a normal interval."""
    half = F.lit(float(z)) * F.col(se)
    return df.withColumns({"lower": F.col(mean) - half, "upper": F.col(mean) + half})
