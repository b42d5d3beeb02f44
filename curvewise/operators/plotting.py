"""Tables behind the figures: lines, error bars, reference lines. No drawing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvewise.operators.curves import curve_peak
from curvewise.operators.fitting import fitted, grouped_poly
from curvewise.operators.joining import natural_join, points_between, sequence_points
from curvewise.operators.ordering import box_stats
from curvewise.operators.summarising import interval_columns, mean_se


def smooth_lines(
    df: DataFrame, series: Sequence[str], x: str, y: str, degree: int = 2, n: int = 80
) -> DataFrame:
    """Least-squares line per series on n points over the series' own x range."""
    coefs = grouped_poly(df, series, x, y, degree)
    shown = df.where(F.col(y).isNotNull())
    spans = shown.groupBy(*series).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    both = natural_join(coefs, spans, "inner", on=series, null_safe=True)
    points = both.withColumn("x", F.explode(points_between(F.col("_lo"), F.col("_hi"), n)))
    return points.select(*series, "x", fitted(F.col("x"), degree).alias("fit")).where(
        F.col("fit").isNotNull()
    )


def error_bars(df: DataFrame, series: Sequence[str], y: str, z: float = 1.0) -> DataFrame:
    return interval_columns(mean_se(df, series, y), z=z).select(*series, "mean", "lower", "upper")


def reference_lines(points: DataFrame, panels: Sequence[str], x: str = "x", y: str = "fit") -> DataFrame:
    return curve_peak(points, panels, x, y).select(*panels, "topt", "popt")


def boxes(df: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """Box statistics; order the boxes by the `median` column."""
    return box_stats(df, keys, y)


def wide_range_curves(
    coefs: DataFrame, keys: Sequence[str], low: float, high: float, n: int, degree: int = 2
) -> DataFrame:
    """The same coefficients on a wider x range than the data."""
    points = coefs.withColumn("x", F.explode(sequence_points(low, high, n)))
    return points.select(*keys, "x", fitted(F.col("x"), degree).alias("fit")).where(
        F.col("fit").isNotNull()
    )
