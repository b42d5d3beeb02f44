"""Looking at a table: column profile, factor levels, frequencies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, type, n, n_null, n_distinct).

    Each column is counted by value on its own, combined in the map tasks: a scan that reads
    this column only and a shuffle of its distinct values. No row is repeated for the number of
    columns. `approximate` replaces the exact distinct counts by sketches in one pass, which
    keeps a profile of a very large table to one row per map task.
    """
    if approximate:
        stats = [
            F.struct(
                F.lit(c).alias("column"),
                F.lit(t).alias("type"),
                F.count(F.lit(1)).alias("n"),
                (F.count(F.lit(1)) - F.count(F.col(c))).alias("n_null"),
                F.approx_count_distinct(F.col(c)).alias("n_distinct"),
            )
            for c, t in df.dtypes
        ]
        return df.agg(F.array(*stats).alias("a")).select(F.inline("a"))
    return reduce(DataFrame.unionByName, [_column_profile(df, c, t) for c, t in df.dtypes])


def _column_profile(df: DataFrame, column: str, kind: str) -> DataFrame:
    values = df.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    return values.agg(
        F.coalesce(F.sum("n"), zero).alias("n"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), zero).alias("n_null"),
        F.count("v").alias("n_distinct"),
    ).select(F.lit(column).alias("column"), F.lit(kind).alias("type"), "n", "n_null", "n_distinct")


def level_audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, level, n) for each factor; counts are combined before the shuffle."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return (
        texts.unpivot([], list(cols), "column", "level")
        .groupBy("column", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def frequencies(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
