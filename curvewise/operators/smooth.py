"""Penalised smooths and local regression per group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvewise.functions.columns import solve_symmetric
from curvewise.operators.joining import attach, spread_out
from curvewise.operators.mixed import one_way_moments
from curvewise.operators.nonlinear import per_x_sums


def smooth_basis(x: Column, knots: Sequence[float]) -> list[Column]:
    """1, x, and a hinge (x - knot)+ per knot."""
    x = x.cast("double")
    hinges = [F.greatest(x - F.lit(float(k)), F.lit(0.0)) for k in knots]
    return [F.lit(1.0), x, *hinges]


def grouped_smooth(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    knots: Sequence[float],
    lambdas: Sequence[float] = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0),
) -> DataFrame:
    """Penalised regression spline per group, penalty chosen by cross-validation score.

    The basis products are one aggregation; only the small matrix of each group
    reaches Python, one row per group. Gives n, lambda, edf, gcv, sse and the
    coefficients as an array (same order as `smooth_basis`).
    """
    basis = smooth_basis(F.col("_x"), knots)
    p = len(basis)
    rows = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    rows = rows.dropna("any", subset=["_x", "_y"]).select(
        *keys, "_y", *[b.alias(f"_b{i}") for i, b in enumerate(basis)]
    )
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col(f"_b{i}") * F.col(f"_b{j}")) for i, j in upper]).alias("xx"),
        F.array(*[F.sum(F.col(f"_b{i}") * F.col("_y")) for i in range(p)]).alias("xy"),
        F.sum(F.col("_y") * F.col("_y")).alias("yy"),
    )
    penalty = np.diag([0.0, 0.0] + [1.0] * len(knots))
    keys = list(keys)
    tried = [float(v) for v in lambdas]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = np.triu_indices(p)
        for pdf in batches:
            m = len(pdf)
            gram = np.zeros((m, p, p))
            gram[:, at[0], at[1]] = np.array(pdf["xx"].tolist(), float).reshape(m, -1)
            gram[:, at[1], at[0]] = gram[:, at[0], at[1]]
            xy = np.array(pdf["xy"].tolist(), float).reshape(m, p)
            n, yy = pdf["n"].to_numpy(float), pdf["yy"].to_numpy(float)
            found = {c: np.full(m, np.nan) for c in ("lambda", "edf", "gcv", "sse")}
            coefs = np.full((m, p), np.nan)
            for lam in tried if m else ():
                inverse = np.linalg.pinv(gram + lam * penalty, hermitian=True)
                beta = np.einsum("gij,gj->gi", inverse, xy)
                sse = yy - 2 * (beta * xy).sum(1) + np.einsum("gi,gij,gj->g", beta, gram, beta)
                sse = np.maximum(sse, 0.0)
                edf = np.einsum("gij,gji->g", inverse, gram)
                free = n - edf
                gcv = n * sse / np.where(free > 1e-6, free, np.nan) ** 2
                better = (gcv < found["gcv"]) | (np.isnan(found["gcv"]) & ~np.isnan(gcv))
                for c, v in (("lambda", np.full(m, lam)), ("edf", edf), ("gcv", gcv), ("sse", sse)):
                    found[c][better] = v[better]
                coefs[better] = beta[better]
            out = pdf[[*keys, "n"]].copy()
            for c, v in found.items():
                out[c] = v
            out["coefs"] = coefs.tolist()
            yield out

    kinds = dict(stats.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return stats.mapInPandas(
        solve,
        f"{schema}, n bigint, lambda double, edf double, gcv double, sse double, coefs array<double>",
    )


def smooth_value(x: Column, knots: Sequence[float]) -> Column:
    """Smooth evaluated at x from a `coefs` column."""
    return sum((b * F.col("coefs")[i] for i, b in enumerate(smooth_basis(x, knots))), F.lit(0.0))


def smooth_points(
    smooths: DataFrame, keys: Sequence[str], knots: Sequence[float], points: Column
) -> DataFrame:
    return smooths.withColumn("x", F.explode(points)).select(
        *keys, "x", smooth_value(F.col("x"), knots).alias("fit")
    )


def smooth_with_offsets(
    df: DataFrame,
    keys: Sequence[str],
    unit: str,
    x: str,
    y: str,
    knots: Sequence[float],
    lambdas: Sequence[float] = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A smooth per group plus shrunken unit offsets from its residuals.

    Gives the smooths, the variance components and the offsets.
    """
    smooths = grouped_smooth(df, keys, x, y, knots, lambdas)
    rows = attach(df.select(*keys, unit, x, y), smooths.select(*keys, "coefs"), keys)
    resid = rows.withColumn("_r", F.col(y) - smooth_value(F.col(x), knots))
    variance, offsets = one_way_moments(resid.select(unit, "_r"), unit, "_r")
    return smooths, variance, offsets


def local_regression(
    df: DataFrame, keys: Sequence[str], x: str, y: str, span: float, points: Column
) -> DataFrame:
    """Local quadratic with tricube weights on an array of x points.

    With a span of 1 or more every observation counts and the bandwidth is the
    largest distance times the span. Rows are combined to per-x sums first; each of
    these is weighted at each evaluation point, and the rows of one group and point
    are summed together.
    """
    if span < 1.0:
        raise ValueError("span must be at least 1")
    sums = per_x_sums(df, keys, x, y)
    ends = sums.groupBy(*keys).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    rows = attach(sums, ends, keys).withColumn("_at", F.explode(points))
    rows = spread_out(rows, *keys, "_at")  # the weighted sums below need no other shuffle
    reach = F.greatest(F.col("_at") - F.col("_lo"), F.col("_hi") - F.col("_at")) * F.lit(float(span))
    rows = rows.withColumns(
        {"_d": F.col("x") - F.col("_at"), "_u": F.abs(F.col("x") - F.col("_at")) / F.when(reach > 0, reach)}
    )
    u, e, m = F.col("_u"), F.col("_d"), F.col("mean")
    rows = rows.withColumn("_v", F.greatest(1 - u * u * u, F.lit(0.0)))
    v = F.col("_v")
    rows = rows.withColumn("_w0", F.col("n") * v * v * v)
    for k in range(1, 5):
        rows = rows.withColumn(f"_w{k}", F.col(f"_w{k - 1}") * e)
    sums = rows.groupBy(*keys, "_at").agg(
        *[F.sum(f"_w{k}").alias(f"_p{k}") for k in range(5)],
        *[F.sum(F.col(f"_w{k}") * m).alias(f"_q{k}") for k in range(3)],
    )
    c = F.col
    gram = {(i, j): c(f"_p{i + j}") for i in range(3) for j in range(i, 3)}
    level = solve_symmetric(gram, [c("_q0"), c("_q1"), c("_q2")], tolerance=1e-12)[0]
    return sums.select(*keys, c("_at").alias("x"), level.alias("fit"))
