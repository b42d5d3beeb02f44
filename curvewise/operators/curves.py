"""Traits of fitted curves. Input: one row per curve key and grid point.

A curve has as many rows as its grid, so windows per key stay small; `segments` of
`curve_area` is for observed series of unknown length.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curvewise.operators.fitting import grouped_linear
from curvewise.operators.joining import attach
from curvewise.operators.ordering import adjacent, argmax_rows
from curvewise.operators.reshaping import labelled_union, to_wide
from curvewise.operators.summarising import paired_contrast


def curve_peak(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "fit") -> DataFrame:
    """Optimum (lowest x at the maximum), peak, tie count, and whether it is at an end."""
    w = W.partitionBy(*keys)
    top = points.withColumn("_top", F.max(y).over(w))
    at_top = F.col(y) == F.col("_top")
    return top.groupBy(*keys).agg(
        F.min(F.when(at_top, F.col(x))).alias("topt"),
        F.max(y).alias("popt"),
        F.sum(F.when(at_top, 1).otherwise(0)).alias("n_ties"),
        F.min(x).alias("_lo"),
        F.max(x).alias("_hi"),
    ).withColumn(
        "at_edge", (F.col("topt") == F.col("_lo")) | (F.col("topt") == F.col("_hi"))
    ).drop("_lo", "_hi")


def curve_area(
    points: DataFrame,
    keys: Sequence[str],
    x: str = "x",
    y: str = "fit",
    baseline: str | None = None,
    segments: int = 0,
    average_repeats: bool = True,
) -> DataFrame:
    """Trapezoid area under each curve; repeated x values are averaged first.

    `baseline='min'` measures from the lowest point of the curve. Points straight
    from a grid have no repeats: `average_repeats=False` then saves a shuffle.
    """
    series = points
    if average_repeats:
        series = points.groupBy(*keys, x).agg(F.avg(y).alias(y))
    pairs = adjacent(series, keys, x, [y], segments)
    width = F.col(x) - F.col(f"prev_{x}")
    area = F.sum(width * (F.col(y) + F.col(f"prev_{y}")) / 2)
    if baseline == "min":
        area = area - F.min(y) * (F.max(x) - F.min(x))
    return pairs.groupBy(*keys).agg(area.alias("auc"))


def curve_ends(
    points: DataFrame, keys: Sequence[str], ends: Mapping[float, str], x: str = "x", y: str = "fit"
) -> DataFrame:
    """Performance at the given end points, one column each (x value -> name)."""
    return to_wide(points.where(F.col(x).isin(*ends)), keys, x, ends, y)


def four_traits(
    points: DataFrame, keys: Sequence[str], ends: Mapping[float, str], x: str = "x", y: str = "fit"
) -> DataFrame:
    """End-point performance, optimum and peak per curve, in one aggregate."""
    at_ends = [F.max(F.when(F.col(x) == F.lit(v), F.col(y))).alias(name) for v, name in ends.items()]
    best = _best(x, y)
    return points.groupBy(*keys).agg(*at_ends, best.alias("_best")).select(
        *keys, *ends.values(), *_optimum()
    )


def _best(x: str, y: str) -> Column:
    """The highest point, the lowest x of it if several are equal, as (y, -x)."""
    return F.max(F.struct(F.col(y).alias("y"), (-F.col(x)).alias("x")))


def _optimum() -> list[Column]:
    return [(-F.col("_best.x")).alias("topt"), F.col("_best.y").alias("popt")]


def peak_and_area(
    points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "fit", baseline: str | None = None
) -> DataFrame:
    """Optimum, peak and area per curve from one pass over the points of a grid."""
    before = W.partitionBy(*keys).orderBy(x)
    pairs = points.withColumns({"_px": F.lag(x).over(before), "_py": F.lag(y).over(before)})
    area = F.sum((F.col(x) - F.col("_px")) * (F.col(y) + F.col("_py")) / 2)
    if baseline == "min":
        area = area - F.min(y) * (F.max(x) - F.min(x))
    return pairs.groupBy(*keys).agg(_best(x, y).alias("_best"), area.alias("auc")).select(
        *keys, *_optimum(), "auc"
    )


def shape_rows(
    points: DataFrame, keys: Sequence[str], low: float, high: float, x: str = "x", y: str = "fit"
) -> DataFrame:
    """Rows of the optimum and both ends, each labelled before they are stacked."""
    cols = [*keys, x, y]
    best = argmax_rows(points, keys, y, bounded=True).select(*cols)
    return labelled_union(
        {
            "Opt": best,
            "Min": points.where(F.col(x) == F.lit(low)).select(*cols),
            "Max": points.where(F.col(x) == F.lit(high)).select(*cols),
        }
    )


def curve_deltas(
    points: DataFrame,
    keys: Sequence[str],
    factor: str,
    a,
    b,
    x: str = "x",
    y: str = "fit",
) -> DataFrame:
    """Difference (level b minus level a) of optimum, peak and baseline area."""
    rest = [k for k in keys if k != factor]
    traits = peak_and_area(points, keys, x, y, baseline="min")
    return paired_contrast(traits, rest, factor, a, b, ["topt", "popt", "auc"])


def turning_point(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "fit") -> DataFrame:
    """Point whose slope is nearest zero; the last x of a curve that only rises and
    the first x of a curve that only falls.

    Slopes are central differences, one-sided at the ends.
    """
    w = W.partitionBy(*keys).orderBy(x)
    left_x, left_y = F.coalesce(F.lag(x).over(w), F.col(x)), F.coalesce(F.lag(y).over(w), F.col(y))
    right_x, right_y = F.coalesce(F.lead(x).over(w), F.col(x)), F.coalesce(F.lead(y).over(w), F.col(y))
    sloped = points.withColumn("_slope", F.try_divide(right_y - left_y, right_x - left_x))
    return sloped.groupBy(*keys).agg(
        F.min("_slope").alias("_min"),
        F.max("_slope").alias("_max"),
        F.min_by(F.struct(x, y), F.struct(F.abs("_slope"), F.col(x))).alias("_flat"),
        F.min_by(F.struct(x, y), F.col(x)).alias("_first"),
        F.max_by(F.struct(x, y), F.col(x)).alias("_last"),
    ).withColumn(
        "_at",
        F.when(F.col("_min") > 0, F.col("_last"))
        .when(F.col("_max") < 0, F.col("_first"))
        .otherwise(F.col("_flat")),
    ).select(*keys, F.col(f"_at.{x}").alias("turn_x"), F.col(f"_at.{y}").alias("turn_y"))


def polynomial_turning_points(coefs: DataFrame, keys: Sequence[str], degree: int) -> DataFrame:
    """Where the derivative of a fitted quadratic or cubic is zero and the curve peaks."""
    b1, b2 = F.col("b1"), F.col("b2")
    if degree == 2:
        at = F.when(b2 < 0, -b1 / (2 * b2))
    else:
        b3 = F.when(F.col("b3") != 0, F.col("b3"))
        disc = b2 * b2 - 3 * b3 * b1
        at = F.when(disc > 0, (-b2 - F.sqrt(F.abs(disc))) / (3 * b3))
    terms = [F.col(f"b{i}") for i in range(degree + 1)]
    value = terms[-1]
    for c in reversed(terms[:-1]):
        value = value * F.col("turn_x") + c
    return coefs.withColumn("turn_x", at).select(*keys, "turn_x", value.alias("turn_y"))


def critical_limits(
    points: DataFrame, keys: Sequence[str], level: float, x: str = "x", y: str = "fit"
) -> DataFrame:
    """On each side of the optimum, the x whose value is nearest to `level`."""
    w = W.partitionBy(*keys)
    top = points.withColumn("_top", F.max(y).over(w))
    placed = top.withColumn("_opt", F.min(F.when(F.col(y) == F.col("_top"), F.col(x))).over(w))
    distance = F.struct(F.abs(F.col(y) - F.lit(float(level))), F.col(x))
    low, high = F.col(x) < F.col("_opt"), F.col(x) > F.col("_opt")
    return placed.groupBy(*keys).agg(
        F.min("_opt").alias("topt"),
        F.min_by(F.col(x), F.when(low, distance)).alias("crit_low"),
        F.min_by(F.col(x), F.when(high, distance)).alias("crit_high"),
    )


def edge_optima(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "fit") -> DataFrame:
    """Curves whose optimum is the highest x."""
    w = W.partitionBy(*keys)
    marked = points.withColumns({"_top": F.max(y).over(w), "_hi": F.max(x).over(w)})
    return marked.where((F.col(y) == F.col("_top")) & (F.col(x) == F.col("_hi"))).select(*keys, x, y)


def exclude_curves(points: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop the curves listed in `edges`; null keys match null keys."""
    return attach(points, edges.select(*keys), keys, "left_anti")


def end_on_peak(
    traits: DataFrame, panels: Sequence[str], end: str, against: str
) -> DataFrame:
    """Line of end-point performance on peak or optimum per panel."""
    return grouped_linear(traits, panels, against, end)
