"""Joins on shared columns, prediction grids and paired trait tables.

Physical choice is left to Spark: no side is hinted, so a side is broadcast only
when its measured size is below the session threshold, and AQE splits skewed
partitions of the sort-merge joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvewise.session import stored

#: Rows of the smaller table that one row of a grid meets at a time.
BUCKET_ROWS = 1000


def _matches(pairs: Sequence[tuple[str, str]], null_safe: bool) -> Column:
    tests = [
        F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) == F.col(b) for a, b in pairs
    ]
    return reduce(lambda x, y: x & y, tests)


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Add the non-key columns of a per-key `table` to rows; null keys match null keys."""
    right = table.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    pairs = [(k, f"_k_{k}") for k in keys]
    return df.join(right, _matches(pairs, True), how).drop(*[b for _, b in pairs])


def natural_join(
    a: DataFrame,
    b: DataFrame,
    how: str = "left",
    on: Sequence[str] | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Join on all shared names (or `on`), keys coalesced and listed first."""
    shared = list(on) if on else [c for c in a.columns if c in b.columns]
    right = b.withColumnsRenamed({k: f"_k_{k}" for k in shared})
    joined = a.join(right, _matches([(k, f"_k_{k}") for k in shared], null_safe), how)
    keys = [F.coalesce(F.col(k), F.col(f"_k_{k}")).alias(k) for k in shared]
    rest = [c for c in a.columns if c not in shared] + [c for c in b.columns if c not in shared]
    return joined.select(*keys, *rest)


def join_suffix(
    a: DataFrame,
    b: DataFrame,
    on: Sequence[str],
    how: str = "full",
    suffixes: tuple[str, str] = ("_x", "_y"),
    null_safe: bool = False,
) -> DataFrame:
    """Join on chosen keys; other names found on both sides get a suffix."""
    clash = [c for c in a.columns if c in b.columns and c not in on]
    left = a.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = b.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return natural_join(left, right, how, on=on, null_safe=null_safe)


def spread_out(df: DataFrame, *by: str) -> DataFrame:
    """Redistribute a small table over all shuffle partitions before a large fan-out.

    Small partitions are otherwise merged, and the rows made from them by explode
    would be computed by few tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *by)


def beside_all(df: DataFrame, few: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every row of `df` next to every row of `few`, of which there may be any number.

    The rows of `few` are dealt into buckets of about `bucket_rows` and each bucket is packed
    into one row. A row of `df` is repeated with the number of every bucket, joined to the
    buckets by number and unpacked there, so that no task holds more than a bucket at a time
    beside its rows. Both tables must give the same rows each time they are computed.
    """
    size = few.agg(F.greatest(F.ceil(F.count(F.lit(1)) / bucket_rows), F.lit(1)).alias("n")).scalar()
    packed = (
        few.select(F.pmod(F.xxhash64(*few.columns), size).alias("_bucket"), F.struct(*few.columns).alias("_row"))
        .groupBy("_bucket")
        .agg(F.collect_list("_row").alias("_rows"))
    )
    rows = df.withColumn("_bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), size - 1)))
    return rows.join(packed, "_bucket").select(*df.columns, F.inline("_rows").alias(*few.columns))


def levels_array(df: DataFrame, col: str, max_levels: int) -> Column:
    """Sorted levels of a factor as a scalar subquery, for callers that need them as one value.

    At most `max_levels + 1` values reach the array; more levels than that is an
    error, since such a column is no factor but belongs to the rows of a table.
    """
    few = df.select(F.col(col).alias("v")).where("v IS NOT NULL").distinct().limit(max_levels + 1)
    levels = F.sort_array(F.collect_list("v"))
    checked = F.when(F.count(F.lit(1)) <= max_levels, levels).otherwise(
        F.raise_error(F.lit(f"{col} has more than {max_levels} levels"))
    )
    return few.agg(checked.alias("levels")).scalar()


def spaced(low: float, high: float, n: int) -> list[float]:
    """n equally spaced points from low to high."""
    step = (high - low) / (n - 1) if n > 1 else 0.0
    return [low + i * step for i in range(n)]


def sequence_points(low: float, high: float, n: int) -> Column:
    """Array literal of n equally spaced points from low to high."""
    return F.expr("array(" + ", ".join(f"{v!r}D" for v in spaced(low, high, n)) + ")")


def points_between(low: Column, high: Column, n: int) -> Column:
    """Array of n equally spaced points between two columns."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: low.cast("double") + i * ((high - low).cast("double") / (n - 1)),
    )


def linspace(spark, low: float, high: float, n: int, name: str = "x") -> DataFrame:
    """n equally spaced points as rows."""
    step = (high - low) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select((F.lit(float(low)) + F.col("id") * F.lit(step)).alias(name))


def steps(spark, low: float, high: float, by: float, name: str = "x") -> DataFrame:
    """Points low, low + by, ... up to high as rows."""
    n = int((high - low) / by + 1e-9) + 1
    return spark.range(n).select((F.lit(float(low)) + F.col("id") * F.lit(float(by))).alias(name))


def prediction_grid(
    df: DataFrame, unit: str, factors: Sequence[str], x: str, low: float, high: float, n: int
) -> DataFrame:
    """Every x point for every unit and every level of every factor.

    Units and levels may be many: both stay rows of distributed tables. The levels are
    written once, since they are counted before they are dealt out.
    """
    grid = df.select(unit).where(F.col(unit).isNotNull()).distinct()
    for f in factors:
        grid = beside_all(grid, stored(df.select(f).where(F.col(f).isNotNull()).distinct()))
    return grid.withColumn(x, F.explode(sequence_points(low, high, n)))


def trait_pair(
    a: DataFrame, b: DataFrame, keys: Sequence[str], ya: str, yb: str, how: str = "full"
) -> DataFrame:
    """Cell means of two tables side by side; both sides are aggregated first."""
    left = a.groupBy(*keys).agg(F.avg(ya).alias(f"mean_{ya}"), F.count(F.lit(1)).alias("n_a"))
    right = b.groupBy(*keys).agg(F.avg(yb).alias(f"mean_{yb}"), F.count(F.lit(1)).alias("n_b"))
    return natural_join(left, right, how, on=keys, null_safe=True)


def paired_rows_summary(
    a: DataFrame, b: DataFrame, keys: Sequence[str], ya: str, yb: str
) -> DataFrame:
    """What a many-to-many full join of two tables gives after averaging per cell.

    Joining on the cell pairs each row of `a` with each row of `b`, which repeats
    every value of `a` n_b times and the reverse. Means per cell and the number of
    joined rows follow from the two aggregated sides, so no pair is ever made.
    """
    out = trait_pair(a, b, keys, ya, yb)
    pairs = F.greatest(F.coalesce("n_a", F.lit(1)), F.lit(1)) * F.greatest(
        F.coalesce("n_b", F.lit(1)), F.lit(1)
    )
    return out.withColumn("n_rows", pairs)
