"""Rows picked or compared by order inside groups.

Row-level groups may be very uneven, so group extremes are aggregated (combined in
the map tasks) and joined back instead of sorting each group in one task. `bounded`
switches to a window for tables whose groups are small by construction, such as
curve points on a grid, where it saves a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curvewise.functions.columns import cols
from curvewise.operators.joining import attach


def group_values(
    df: DataFrame, keys: Sequence[str], bounded: bool = False, **aggregates: Column
) -> DataFrame:
    """Add group-wide aggregates to each row."""
    if bounded:
        w = W.partitionBy(*keys)
        return df.withColumns({name: agg.over(w) for name, agg in aggregates.items()})
    stats = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggregates.items()])
    return attach(df, stats, keys)


def argmax_rows(df: DataFrame, keys: Sequence[str], y: str, bounded: bool = False) -> DataFrame:
    """All rows that reach the group maximum, ties kept."""
    marked = group_values(df, keys, bounded, _best=F.max(y))
    return marked.where(F.col(y) == F.col("_best")).drop("_best")


def top_n(df: DataFrame, keys: Sequence[str], y: str, n: int) -> DataFrame:
    """Rows whose descending minimum rank is at most n, ties kept.

    The n-th largest value per key comes from a row_number filter, which Spark
    applies already in the map tasks (at most n rows per key and task are
    shuffled); all rows from that value on are then kept.
    """
    w = W.partitionBy(*keys).orderBy(F.col(y).desc())
    best = (
        df.select(*keys, y)
        .where(F.col(y).isNotNull())
        .withColumn("_i", F.row_number().over(w))
        .where(F.col("_i") <= n)
        .groupBy(*keys)
        .agg(F.min(y).alias("_cut"))
    )
    return attach(df, best, keys, "inner").where(F.col(y) >= F.col("_cut")).drop("_cut")


def first_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ys: Sequence[str]
) -> DataFrame:
    """Add the first and last value by `order` (with its tie-breaks) to each row."""
    by = F.col(order[0]) if len(order) == 1 else F.struct(*cols(order))
    ends = {}
    for y in ys:
        ends[f"first_{y}"] = F.min_by(F.col(y), by)
        ends[f"last_{y}"] = F.max_by(F.col(y), by)
    return group_values(df, keys, **ends)


def nearest_row(
    df: DataFrame, keys: Sequence[str], y: str, target: float, order: Sequence[str]
) -> DataFrame:
    """The row nearest to a target value per key; `order` breaks ties."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(F.abs(F.col(y) - F.lit(float(target))).alias("_d"), *cols(order))
    picked = F.min_by(F.struct(*cols(rest)), F.when(F.col(y).isNotNull(), by))
    return df.groupBy(*keys).agg(picked.alias("_r")).select(*keys, "_r.*")


def segment(
    df: DataFrame, keys: Sequence[str], by: str, probs: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """Cut each group into ordered segments: `seg` never falls when `by` rises.

    The cut points are quantile sketches, built by partial aggregation with bounded
    memory. Any cut points give right results; good ones give even segments.
    """
    sketch = df.groupBy(*keys).agg(
        F.percentile_approx(by, F.array(*[F.lit(float(p)) for p in probs]), accuracy).alias("_cuts")
    )
    seg = sum(
        (F.when(F.col(by) > F.col("_cuts")[i], 1).otherwise(0) for i in range(len(probs))), F.lit(0)
    )
    return attach(df, sketch, keys).withColumn("seg", seg).drop("_cuts")


def adjacent(
    df: DataFrame, keys: Sequence[str], x: str, ys: Sequence[str], segments: int = 0
) -> DataFrame:
    """Add the previous row's x and ys (`prev_*`) by x order; x is unique per key.

    With `segments` a group is cut into that many ordered pieces which are handled
    in different tasks; only the last row of each piece is passed on to the next.
    """
    names = [x, *ys]
    if not segments:
        w = W.partitionBy(*keys).orderBy(x)
        return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in names})
    cut = segment(df, keys, x, [(i + 1) / segments for i in range(segments - 1)])
    w = W.partitionBy(*keys, "seg").orderBy(x)
    inside = cut.withColumn("_prev", F.lag(F.struct(*cols(names))).over(w))
    tails = cut.groupBy(*keys, "seg").agg(F.max_by(F.struct(*cols(names)), F.col(x)).alias("_tail"))
    before = tails.withColumn(
        "_before", F.lag("_tail").over(W.partitionBy(*keys).orderBy("seg"))
    ).drop("_tail")
    out = attach(inside, before, [*keys, "seg"])
    prev = F.coalesce(F.col("_prev"), F.col("_before"))
    return out.withColumns({f"prev_{c}": prev[c] for c in names}).drop(
        "seg", "_prev", "_before"
    )


def differences(
    df: DataFrame, keys: Sequence[str], x: str, y: str, segments: int = 0
) -> DataFrame:
    """y minus the previous y by x order."""
    out = adjacent(df, keys, x, [y], segments)
    return out.withColumn("diff", F.col(y) - F.col(f"prev_{y}")).drop(f"prev_{x}", f"prev_{y}")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    y: str,
    probs: Sequence[float],
    max_group: int | None = None,
) -> DataFrame:
    """(keys, prob, quantile) with linear interpolation between order statistics.

    Every group is solved by bracketing, in one way for all sizes. The built-in percentile
    keeps the distinct values of a group in one buffer; a caller who knows that groups are
    small can ask for it with `max_group`, which costs a count of the rows per key and
    leaves groups above it to bracketing.
    """
    rows = df.select(*keys, y).where(F.col(y).isNotNull())
    if max_group is None:
        return _bracketed_quantiles(rows, keys, y, probs)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    big = sizes.where(F.col("_n") > max_group).drop("_n").withColumn("_big", F.lit(True))
    if not big.take(1):
        return _buffered_quantiles(rows, keys, y, probs)
    marked = attach(rows, big, keys)
    small = marked.where(F.col("_big").isNull()).drop("_big")
    large = marked.where(F.col("_big")).drop("_big")
    return _buffered_quantiles(small, keys, y, probs).unionByName(
        _bracketed_quantiles(large, keys, y, probs)
    )


def _buffered_quantiles(
    rows: DataFrame, keys: Sequence[str], y: str, probs: Sequence[float]
) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    found = rows.groupBy(*keys).agg(F.percentile(y, wanted).alias("_q"))
    pairs = F.arrays_zip(wanted.alias("prob"), F.col("_q").alias("quantile"))
    return found.select(*keys, F.inline(pairs).alias("prob", "quantile"))


def _bracketed_quantiles(
    rows: DataFrame, keys: Sequence[str], y: str, probs: Sequence[float], spread: float = 0.001
) -> DataFrame:
    """Exact quantiles of groups of any size.

    A sketch brackets each quantile, the rows are counted per bracket, and only the
    values of the few brackets that hold a wanted order statistic are ordered. For a
    group of n rows that is about 2 * spread * n rows per quantile. The result is
    exact whatever the quality of the sketch.
    """
    cuts = sorted(
        {min(max(p + d, 0.0), 1.0) for p in probs for d in (-spread, spread)}
    )
    cut = segment(rows, keys, y, cuts)
    per_seg = cut.groupBy(*keys, "seg").agg(F.count(F.lit(1)).alias("_c"))
    running = W.partitionBy(*keys).orderBy("seg").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    spans = per_seg.withColumn("_end", F.sum("_c").over(running)).withColumn(
        "_n", F.sum("_c").over(whole)
    )
    wanted = F.array(
        *[
            F.struct(F.lit(float(p)).alias("prob"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("pos"))
            for p in probs
        ]
    )
    ranks = (
        spans.select(*keys, "seg", "_c", "_end", F.inline(wanted))
        .withColumn("_rank", F.explode(F.array(F.floor("pos"), F.ceil("pos"))))
        .where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_c")))
        .withColumn("_rank", F.col("_rank") - (F.col("_end") - F.col("_c")))
        .distinct()
    )
    per_target = ranks.groupBy(*keys, "seg").agg(
        F.collect_set(F.struct("prob", "pos", "_rank", (F.col("_end") - F.col("_c")).alias("_base"))).alias("_t")
    )
    values = (
        attach(cut, per_target, [*keys, "seg"], "inner")
        .groupBy(*keys, "seg", y)
        .agg(F.count(F.lit(1)).alias("_c"), F.any_value("_t").alias("_t"))
    )
    inside = W.partitionBy(*keys, "seg").orderBy(y).rowsBetween(W.unboundedPreceding, 0)
    hits = (
        values.withColumn("_end", F.sum("_c").over(inside))
        .select(*keys, y, "_c", "_end", F.inline("_t"))
        .where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_c")))
    )
    ends = hits.groupBy(*keys, "prob", "pos").agg(F.min(y).alias("_lo"), F.max(y).alias("_hi"))
    between = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("pos") - F.floor("pos"))
    return ends.select(*keys, "prob", between.alias("quantile"))


def quantile_columns(
    df: DataFrame, keys: Sequence[str], y: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles as one column per name."""
    q = exact_quantiles(df, keys, y, list(probs.values()))
    picked = [
        F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(name)
        for name, p in probs.items()
    ]
    return q.groupBy(*keys).agg(*picked)


def rank_groups_by_median(df: DataFrame, unit: str, y: str) -> DataFrame:
    """(unit, median): sort it by median and unit to order the units of a plot."""
    return quantile_columns(df, [unit], y, {"median": 0.5})


def box_stats(df: DataFrame, keys: Sequence[str], y: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends within reach * IQR of the hinges, and outlier count."""
    hinges = quantile_columns(df, keys, y, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    rows = attach(df.select(*keys, y).where(F.col(y).isNotNull()), hinges, keys)
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col(y) >= F.col("q1") - reach * iqr) & (F.col(y) <= F.col("q3") + reach * iqr)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col(y))).alias("whisker_low"),
        F.max(F.when(inside, F.col(y))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(1)).alias("n_outliers"),
    )
