"""Traits derived per individual or cell from observation logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvewise.functions.columns import cols, strict_mean, total
from curvewise.operators.joining import natural_join
from curvewise.operators.summarising import (
    cell_means,
    mean_se,
    nested_mean_se,
    nested_total_mean_se,
)


def lifetime_output(df: DataFrame, keys: Sequence[str], count: str, size: str) -> DataFrame:
    """Lifetime output and effort per individual over rows with at least one offspring.

    Effort divides the output by the mean size, which is missing if one size is.
    """
    return (
        df.where(F.col(count) >= 1)
        .groupBy(*keys)
        .agg(
            F.sum(count).alias("output"),
            F.try_divide(F.sum(count), strict_mean(F.col(size))).alias("effort"),
        )
    )


def net_reproduction(
    df: DataFrame,
    keys: Sequence[str],
    stage: str,
    stages: Sequence[str],
    lx: str,
    mx: str,
    cumulative: bool = False,
) -> DataFrame:
    """Sum of survival x births over the chosen stages per cell.

    A missing product is left out and a cell without any product gives 0. With
    `cumulative` there is one column per stage, summed up to and including it.
    """
    chosen = df.where(F.col(stage).isin(*stages))
    product = F.col(lx) * F.col(mx)
    if not cumulative:
        return chosen.groupBy(*keys).agg(total(product).alias("ro"))
    sums = [
        total(F.when(F.col(stage).isin(*stages[: i + 1]), product)).alias(f"ro_{s.lower()}")
        for i, s in enumerate(stages)
    ]
    return chosen.groupBy(*keys).agg(*sums)


def growth_slope(df: DataFrame, keys: Sequence[str], age: str, size: str) -> DataFrame:
    """Slope of log size on age per individual; one distinct age gives null."""
    log_size = F.when(F.col(size) > 0, F.log(size))
    return df.groupBy(*keys).agg(
        F.regr_slope(log_size, F.col(age).cast("double")).alias("growth"),
        F.count(log_size).alias("n"),
    )


def growth_endpoint(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    age: str,
    size: str,
    elapsed: bool = False,
) -> DataFrame:
    """log(last size / first size) / last age per individual.

    `elapsed` divides by the time between first and last row instead.
    """
    by = F.struct(*cols(order))
    ends = df.groupBy(*keys).agg(
        F.min_by(F.struct(age, size), by).alias("_a"), F.max_by(F.struct(age, size), by).alias("_b")
    )
    ratio = F.try_divide(F.col(f"_b.{size}"), F.col(f"_a.{size}"))
    span = F.col(f"_b.{age}") - F.col(f"_a.{age}") if elapsed else F.col(f"_b.{age}")
    growth = F.try_divide(F.when(ratio > 0, F.log(ratio)), span.cast("double"))
    return ends.select(*keys, growth.alias("growth"))


def max_score(df: DataFrame, keys: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
    """Largest weighted sum of score columns per individual."""
    score: Column = sum((F.lit(w) * F.col(c) for c, w in weights.items()), F.lit(0.0))
    return df.groupBy(*keys).agg(F.max(score).alias("score"))


def at_stage(df: DataFrame, stage: str, value: str) -> DataFrame:
    """Rows at one stage, such as maturity."""
    return df.where(F.col(stage) == F.lit(value))


def brood_summaries(
    df: DataFrame,
    stage: str,
    stages: Sequence[str],
    individual: Sequence[str],
    cell: Sequence[str],
    count: str,
) -> DataFrame:
    """Mean and total brood size per individual, then mean and SE per cell."""
    broods = df.where(F.col(stage).isin(*stages))
    means = nested_mean_se(broods, individual, cell, count).withColumnsRenamed(
        {"n": "n_mean", "mean": "mean_brood", "se": "se_brood"}
    )
    totals = nested_total_mean_se(broods, individual, cell, count).withColumnsRenamed(
        {"n": "n_total", "mean": "mean_total", "se": "se_total"}
    )
    return natural_join(means, totals, "full", on=cell, null_safe=True)


def plasticity(
    df: DataFrame, keys: Sequence[str], factor: str, a, b, y: str, score: str
) -> DataFrame:
    """Mean response at level a minus at level b, next to the mean score at level b.

    The two levels are averaged per key first: joining individuals would pair all of
    them and give the same means.
    """
    at_a, at_b = F.col(factor) == F.lit(a), F.col(factor) == F.lit(b)
    return df.groupBy(*keys).agg(
        (F.avg(F.when(at_a, F.col(y))) - F.avg(F.when(at_b, F.col(y)))).alias("delta"),
        F.avg(F.when(at_b, F.col(score))).alias("mean_score"),
    )


def tradeoff_table(df: DataFrame, keys: Sequence[str], score: str, response: str) -> DataFrame:
    """Mean score against mean response per cell."""
    return cell_means(df, keys, [score, response])


def stage_means(
    df: DataFrame, stage: str, value: str, keys: Sequence[str], y: str
) -> DataFrame:
    """Mean and SE of a measure over the rows at one stage."""
    return mean_se(at_stage(df, stage, value), keys, y)
