"""Label cleaning, complete cases, standardising and the analysis frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvewise.functions.columns import cols, composite_key, recode, relabel
from curvewise.operators.joining import attach


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows without a missing value in any (or the given) column."""
    return df.dropna("any", subset=list(columns) if columns else None)


def clean_labels(
    df: DataFrame,
    drops: Mapping[str, Sequence] | None = None,
    merges: Mapping[str, Mapping] | None = None,
    recodes: Mapping[str, Mapping] | None = None,
) -> DataFrame:
    """Drop bad levels, merge levels into others, and recode strictly.

    A row whose level is missing is dropped with the bad levels, as a comparison
    with a missing value is not true. `merges` keeps unlisted levels, `recodes`
    turns them into null. Bad sub-units can thus be dropped or merged.
    """
    for c, levels in (drops or {}).items():
        df = df.where(~F.col(c).isin(*levels))
    changed = {c: relabel(F.col(c), m) for c, m in (merges or {}).items()}
    changed.update({c: recode(F.col(c), m) for c, m in (recodes or {}).items()})
    return df.withColumns(changed) if changed else df


def standardize(
    df: DataFrame, ys: Sequence[str], keys: Sequence[str] | None = None, suffix: str = "_z"
) -> DataFrame:
    """z-scores over the whole table, or per key; missing values are ignored.

    The whole-table statistics are one row and enter as a scalar subquery; no row
    is moved. Per-key statistics are aggregated and joined back.
    """
    stats = [F.avg(y).alias(f"_m_{y}") for y in ys] + [F.stddev_samp(y).alias(f"_s_{y}") for y in ys]
    if keys:
        out = attach(df, df.groupBy(*keys).agg(*stats), keys)
        at = ""
    else:
        out = df.withColumn("_z", df.agg(F.struct(*stats).alias("z")).scalar())
        at = "_z."
    scaled = {
        y + suffix: F.try_divide(F.col(y) - F.col(f"{at}_m_{y}"), F.col(f"{at}_s_{y}")) for y in ys
    }
    return out.withColumns(scaled).select(*df.columns, *scaled)


def analysis_frame(
    df: DataFrame,
    ys: Sequence[str],
    key_parts: Sequence[str],
    key: str = "factorial",
    exclude: Mapping[str, Sequence] | None = None,
    sep: str = ":",
) -> DataFrame:
    """Drop sparse units, standardise, add the composite key, keep complete cases.

    The z-scores come before the complete-case step on purpose: rows that are later
    dropped for another missing column still count in the mean and sd.
    """
    kept = clean_labels(df, drops=exclude) if exclude else df
    scaled = standardize(kept, ys)
    return complete_cases(scaled.withColumn(key, composite_key(cols(key_parts), sep)))


def extremes(df: DataFrame, x: str, values: Sequence) -> DataFrame:
    """Keep only the rows at the given (lowest and highest) x values."""
    return df.where(F.col(x).isin(*values))
