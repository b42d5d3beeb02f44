"""Least-squares curves per group in closed form.

Each fit is one hash aggregation of variances and covariances (numerically stable,
combined in the map tasks) followed by column expressions; polynomials first take the
mean and sd of x per group. No row leaves the JVM and a group of any size costs one
buffer per map task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvewise.functions.columns import polynomial, solve_symmetric
from curvewise.operators.joining import attach, spread_out


def _moments(
    df: DataFrame,
    keys: Sequence[str],
    y: str,
    terms: Mapping[str, Column],
    checked: Sequence[str] | None = None,
    carried: Sequence[str] = (),
) -> DataFrame:
    """n, means, variances and covariances of terms and response over complete rows.

    `checked` names the terms whose presence implies that of the others, `carried` columns
    that have one value per group and stay in the result.
    """
    names = list(terms)
    present = F.col(y).isNotNull()
    for name in names if checked is None else checked:
        present = present & terms[name].isNotNull()
    rows = df.where(present).select(
        *keys, *carried, F.col(y).cast("double").alias("_y"), *[c.alias(f"_{n}") for n, c in terms.items()]
    )
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("_y").alias("_my"), F.var_samp("_y").alias("_yy")]
    aggs += [F.first(c).alias(c) for c in carried]
    for i, a in enumerate(names):
        aggs.append(F.avg(f"_{a}").alias(f"_m{i}"))
        aggs.append(F.covar_samp(f"_{a}", "_y").alias(f"_r{i}"))
        aggs.append(F.var_samp(f"_{a}").alias(f"_s{i}{i}"))
        for j in range(i + 1, len(names)):
            aggs.append(F.covar_samp(f"_{a}", f"_{names[j]}").alias(f"_s{i}{j}"))
    return rows.groupBy(*keys).agg(*aggs)


def _scaled_rows(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Complete rows with `_x`, `_v`, and `_center` and `_scale`: mean and sd of x in the group,
    which a first aggregate finds. A group whose x does not vary has scale 1."""
    value = F.col(x).cast("double")
    rows = df.where(value.isNotNull() & F.col(y).isNotNull()).select(
        *keys, value.alias("_x"), F.col(y).cast("double").alias("_v")
    )
    sd = F.stddev_pop("_x")
    center, scale = F.avg("_x").alias("_center"), F.when(sd > 0, sd).otherwise(1.0).alias("_scale")
    if keys:
        return attach(rows, rows.groupBy(*keys).agg(center, scale), keys, "inner")
    return rows.withColumns({"_center": rows.agg(center).scalar(), "_scale": rows.agg(scale).scalar()})


def scaled_moments(df: DataFrame, keys: Sequence[str], x: str, y: str, degree: int) -> DataFrame:
    """Moments of the powers of (x - center) / scale, with each group's own mean and sd of x.

    Centre and scale, joined to the rows, keep the powers apart wherever x lies (Kelvin, years,
    day numbers), which raw powers are not.
    """
    z = (F.col("_x") - F.col("_center")) / F.col("_scale")
    terms = {"x1": z}
    for d in range(2, degree + 1):
        terms[f"x{d}"] = terms[f"x{d - 1}"] * z
    return _moments(
        _scaled_rows(df, keys, x, y), keys, "_v", terms, checked=["x1"], carried=["_center", "_scale"]
    )


def _slopes(p: int) -> list[Column]:
    """Slopes of the first p terms of a moment table."""
    s = {(i, j): F.col(f"_s{i}{j}") for i in range(p) for j in range(i, p)}
    return solve_symmetric(s, [F.col(f"_r{i}") for i in range(p)])


def _explained(slopes: Sequence[Column]) -> Column:
    return sum((b * F.col(f"_r{i}") for i, b in enumerate(slopes)), F.lit(0.0))


def _sse(explained: Column) -> Column:
    return F.greatest((F.col("n") - 1) * (F.col("_yy") - explained), F.lit(0.0))


def grouped_design(
    df: DataFrame,
    keys: Sequence[str],
    y: str,
    terms: Mapping[str, Column],
    checked: Sequence[str] | None = None,
) -> DataFrame:
    """Regress y on up to three term expressions per group.

    Gives b0, b1, ... in term order, n, sse, sst and r2. Rows with a missing term or
    response are left out. Groups with too few distinct term values give null.
    """
    p = len(terms)
    if p > 3:
        raise ValueError("at most 3 terms; use fit_linear for more")
    stats = _moments(df, keys, y, terms, checked)
    out = stats.withColumns({f"b{i + 1}": b for i, b in enumerate(_slopes(p))})
    b0 = F.col("_my")
    for i in range(p):
        b0 = b0 - F.col(f"b{i + 1}") * F.col(f"_m{i}")
    explained = _explained([F.col(f"b{i + 1}") for i in range(p)])
    valid = F.col("b1").isNotNull()
    return out.select(
        *keys,
        "n",
        b0.alias("b0"),
        *[F.col(f"b{i + 1}") for i in range(p)],
        F.when(valid, _sse(explained)).alias("sse"),
        ((F.col("n") - 1) * F.col("_yy")).alias("sst"),
        F.try_divide(explained, F.col("_yy")).alias("r2"),
    )


def grouped_linear(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Intercept, slope, r2 and n per group."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*keys).agg(
        F.regr_count(ys, xs).alias("n"),
        F.regr_intercept(ys, xs).alias("intercept"),
        F.regr_slope(ys, xs).alias("slope"),
        F.regr_r2(ys, xs).alias("r2"),
    )


def grouped_poly(
    df: DataFrame, keys: Sequence[str], x: str, y: str, degree: int = 2, centred: bool = False
) -> DataFrame:
    """Polynomial of degree 1 to 3 per group.

    It is solved on x scaled per group; a group has null coefficients only if it has too few
    distinct x. Coefficients are those of raw x, or with `centred` those of x - center, with
    a column `center`: the form to evaluate when x is large against its spread, where the
    terms of the raw form cancel. `curve_points` and `augment` take both forms.
    """
    if not 1 <= degree <= 3:
        raise ValueError("degree must be 1 to 3")
    slopes = _slopes(degree)
    stats = scaled_moments(df, keys, x, y, degree).withColumns(
        {f"_g{i + 1}": g for i, g in enumerate(slopes)}
    )
    g = [F.col(f"_g{i + 1}") for i in range(degree)]
    level = F.col("_my")
    about = {}
    for i in range(degree):
        level = level - g[i] * F.col(f"_m{i}")
        about[f"_a{i + 1}"] = g[i] / F.pow("_scale", F.lit(i + 1))
    stats = stats.withColumns({"_a0": level, **about})
    coefs = [F.col(f"_a{j}") for j in range(degree + 1)]
    if not centred:
        coefs = [
            sum(
                (coefs[j] * comb(j, k) * F.pow(-F.col("_center"), F.lit(j - k)) for j in range(k + 1, degree + 1)),
                coefs[k],
            )
            for k in range(degree + 1)
        ]
    explained = _explained(g)
    return stats.select(
        *keys,
        "n",
        *[b.alias(f"b{k}") for k, b in enumerate(coefs)],
        F.when(g[0].isNotNull(), _sse(explained)).alias("sse"),
        ((F.col("n") - 1) * F.col("_yy")).alias("sst"),
        F.try_divide(explained, F.col("_yy")).alias("r2"),
        *([F.col("_center").alias("center")] if centred else []),
    )


def _log_remainder(t: Column, tau: Column) -> Column:
    """What log(1 + t) adds to a quadratic in t, as a term of the size of a cubic.

    3 (log(1 + t) - t + t^2 / 2) / tau^3. The difference loses its digits where t is small;
    there the series 1 - 3t/4 + 3t^2/5 - ... of the quotient by t^3 / 3 is summed instead.
    """
    series = F.lit(0.0)
    for k in range(11, -1, -1):
        series = F.lit(3.0 * (-1) ** k / (k + 3)) + t * series
    direct = 3 * (F.log1p(t) - t + t * t / 2)
    return F.when(F.abs(t) < 0.04, t * t * t * series).otherwise(direct) / (tau * tau * tau)


def fractional_moments(df: DataFrame, keys: Sequence[str], x: str, y: str, shift: float = 0.0) -> DataFrame:
    """Moments of z, the remainder of the log, and z^2, where z = (x - center) / scale.

    Together with a constant these span the same curves as x, log(x + shift) and x^2, which
    come so close to each other far from zero that raw sums cannot tell them apart. Rows
    where x + shift is not positive are left out.
    """
    rows = _scaled_rows(df.where(F.col(x).cast("double") + shift > 0), keys, x, y)
    level = F.col("_center") + shift
    z = (F.col("_x") - F.col("_center")) / F.col("_scale")
    rest = _log_remainder((F.col("_x") - F.col("_center")) / level, F.col("_scale") / level)
    return _moments(
        rows, keys, "_v", {"z": z, "rest": rest, "z2": z * z}, checked=["z"], carried=["_center", "_scale"]
    )


def grouped_fractional(
    df: DataFrame, keys: Sequence[str], x: str, y: str, shift: float = 0.0, centred: bool = False
) -> DataFrame:
    """Fractional polynomial b0 + b1 x + b2 log(x + shift) + b3 x^2 per group, with n, sse, sst, r2.

    It is solved on terms scaled per group and mapped back. With `centred` the coefficients
    stay those of z, the log's remainder and z^2, with columns `center` and `scale`: the form
    for `fractional_fitted` when x is large against its spread, where raw terms cancel.
    Groups with too few distinct x have null coefficients.
    """
    stats = fractional_moments(df, keys, x, y, shift).withColumns(
        {f"_g{i + 1}": g for i, g in enumerate(_slopes(3))}
    )
    g1, g2, g3 = (F.col(f"_g{i}") for i in (1, 2, 3))
    g0 = F.col("_my") - g1 * F.col("_m0") - g2 * F.col("_m1") - g3 * F.col("_m2")
    coefs, place = [g0, g1, g2, g3], []
    if centred:
        place = [F.col("_center").alias("center"), F.col("_scale").alias("scale")]
    else:
        c, s = F.col("_center"), F.col("_scale")
        level = c + shift
        tau = s / level
        log = 3 * g2 / (tau * tau * tau)
        coefs = [
            g0 - g1 * c / s + g3 * c * c / (s * s) + log * (c / level + c * c / (2 * level * level) - F.log(level)),
            g1 / s - 2 * g3 * c / (s * s) - log * (1 / level + c / (level * level)),
            log,
            g3 / (s * s) + log / (2 * level * level),
        ]
    explained = _explained([g1, g2, g3])
    return stats.select(
        *keys,
        "n",
        *[b.alias(f"b{k}") for k, b in enumerate(coefs)],
        F.when(g1.isNotNull(), _sse(explained)).alias("sse"),
        ((F.col("n") - 1) * F.col("_yy")).alias("sst"),
        F.try_divide(explained, F.col("_yy")).alias("r2"),
        *place,
    )


def fractional_fitted(x: Column, shift: float = 0.0, centred: bool = False) -> Column:
    """Value of a fractional polynomial from the columns of `grouped_fractional`."""
    b0, b1, b2, b3 = (F.col(f"b{i}") for i in range(4))
    x = x.cast("double")
    inside = F.when(x + shift > 0, x)
    if not centred:
        return b0 + b1 * x + b2 * F.log(inside + shift) + b3 * x * x
    level = F.col("center") + shift
    z = (x - F.col("center")) / F.col("scale")
    return b0 + b1 * z + b2 * _log_remainder((inside - F.col("center")) / level, F.col("scale") / level) + b3 * z * z


def vertex_form(coefs: DataFrame) -> DataFrame:
    """Add a, h, k of a(x - h)^2 + k to quadratic coefficients.

    A flat curve (b2 = 0) has no vertex; `convex` marks curves with a minimum.
    """
    b2 = F.when(F.col("b2") != 0, F.col("b2"))
    return coefs.withColumns(
        {
            "a": F.col("b2"),
            "h": -F.col("b1") / (2 * b2),
            "k": F.col("b0") - F.col("b1") * F.col("b1") / (4 * b2),
            "convex": F.col("b2") > 0,
        }
    )


def grouped_vertex(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    about = vertex_form(grouped_poly(df, keys, x, y, 2, centred=True))
    return about.select(*keys, "n", "a", (F.col("h") + F.col("center")).alias("h"), "k", "convex")


def fitted(x: Column, degree: int, centred: bool = False) -> Column:
    """Polynomial value from columns b0 .. b<degree>, about column center if `centred`."""
    at = x - F.col("center") if centred else x
    return polynomial(at, [F.col(f"b{i}") for i in range(degree + 1)])


def _coefficients(coefs: DataFrame, degree: int) -> tuple[list[str], bool]:
    """Names of the coefficient columns, and whether they are about a centre."""
    centred = "center" in coefs.columns
    return [f"b{i}" for i in range(degree + 1)] + ["center"] * centred, centred


def curve_points(
    coefs: DataFrame, keys: Sequence[str], points: Column, degree: int = 2, x: str = "x", y: str = "fit"
) -> DataFrame:
    """Evaluate each group's polynomial on an array of x points.

    The coefficients, one row per curve, are spread by key over all tasks before the
    points are exploded next to them; later per-key steps need no new shuffle.
    """
    names, centred = _coefficients(coefs, degree)
    rows = spread_out(coefs.select(*keys, *names), *keys).select("*", F.explode(points).alias(x))
    return rows.select(*keys, x, fitted(F.col(x), degree, centred).alias(y)).where(F.col(y).isNotNull())


def augment(
    df: DataFrame, coefs: DataFrame, keys: Sequence[str], x: str, y: str, degree: int = 2
) -> DataFrame:
    """Rows with fitted value, residual and standardised residual."""
    names, centred = _coefficients(coefs, degree)
    rows = attach(df.select(*keys, x, y), coefs.select(*keys, "n", "sse", *names), keys, "inner")
    sigma = F.sqrt(F.try_divide(F.col("sse"), F.col("n") - (degree + 1)))
    return rows.withColumns(
        {"fitted": fitted(F.col(x).cast("double"), degree, centred)}
    ).withColumns({"resid": F.col(y) - F.col("fitted")}).select(
        *keys, x, y, "fitted", "resid", F.try_divide(F.col("resid"), sigma).alias("std_resid")
    )


def aic(n: Column, sse: Column, parameters: int | Column) -> Column:
    """n ln(sse / n) + 2 k; null for a perfect fit."""
    n = n.cast("double")
    ratio = F.try_divide(sse, n)
    return n * F.when(ratio > 0, F.log(ratio)) + 2 * F.lit(parameters)


def polynomial_aics(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """AIC of the line, the quadratic and the cubic per group, and the best of them.

    The moments of the cubic hold those of the other two: one aggregation for all.
    """
    stats = scaled_moments(df, keys, x, y, 3)
    models = ["linear", "quadratic", "cubic"]
    for degree, name in enumerate(models, start=1):
        slopes = _slopes(degree)
        sse = F.when(slopes[0].isNotNull(), _sse(_explained(slopes)))
        stats = stats.withColumn(f"aic_{name}", aic(F.col("n"), sse, degree + 2))
    ranked = F.array(
        *[
            F.struct(F.col(f"aic_{m}").alias("aic"), F.lit(i).alias("size"), F.lit(m).alias("model"))
            for i, m in enumerate(models)
        ]
    )
    best = F.array_min(F.filter(ranked, lambda s: s["aic"].isNotNull()))
    return stats.select(
        *keys,
        "n",
        *[f"aic_{m}" for m in models],
        best["model"].alias("best"),
        (F.col("aic_linear") - F.col("aic_quadratic")).alias("delta_aic"),
    )
