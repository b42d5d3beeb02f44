"""Mixed models with random curves per unit.

Two forms. The moment form (random intercept) is only aggregations and joins. The
likelihood form takes random polynomial terms per unit: the rows are reduced once to
per-unit matrices, which stay a distributed table; every evaluation of the restricted
likelihood is a sum over that table, made in tasks for a batch of candidate
covariances at a time. The driver sees sums of fixed size only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvewise.functions.tails import chi2_tail, f_tail
from curvewise.operators.fitting import fitted, grouped_poly
from curvewise.operators.joining import attach, beside_all, sequence_points, spread_out
from curvewise.operators.linear import (
    Design,
    _columns_of,
    _table,
    build_design,
    cell_moments,
)
from curvewise.session import cut_lineage, stored

# --- moment form -----------------------------------------------------------


@dataclass
class MomentFit:
    """Fixed polynomial per panel plus shrunken unit offsets."""

    panels: list[str]
    unit: str
    degree: int
    coefs: DataFrame
    variance: DataFrame
    offsets: DataFrame


def one_way_moments(df: DataFrame, unit: str, y: str) -> tuple[DataFrame, DataFrame]:
    """Variance components of a one-way layout, and the shrunken unit offsets.

    Between and within mean squares give sigma2 and tau2 (not below zero); each unit
    mean is pulled to the grand mean by n / (n + sigma2 / tau2). The rows are summed once; the
    table of units is written and everything else is taken from it.
    """
    rows = df.select(unit, F.col(y).cast("double").alias("_y")).dropna("any")
    units = stored(
        rows.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean"), F.var_pop("_y").alias("_v"))
    )
    n, mean = F.col("n"), F.col("mean")
    sums = units.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("units"),
        F.try_divide(F.sum(n * mean), F.sum(n)).alias("grand_mean"),
        F.sum(n * n).alias("_nn"),
        F.sum(n * F.col("_v")).alias("_within"),
    )
    centred = units.withColumn("_g", sums.select("grand_mean").scalar())
    between = centred.agg(F.sum(n * (mean - F.col("_g")) * (mean - F.col("_g"))).alias("b"))
    size = F.col("rows").cast("double")
    variance = (
        sums.withColumn("_between", between.scalar())
        .withColumn("sigma2", F.try_divide(F.col("_within"), size - F.col("units")))
        .withColumn("_msb", F.try_divide(F.col("_between"), (F.col("units") - 1).cast("double")))
        .withColumn(
            "_n0",
            F.try_divide(
                size - F.try_divide(F.col("_nn").cast("double"), size),
                (F.col("units") - 1).cast("double"),
            ),
        )
        .withColumn(
            "tau2",
            F.greatest(F.try_divide(F.col("_msb") - F.col("sigma2"), F.col("_n0")), F.lit(0.0)),
        )
        .select("rows", "units", "grand_mean", "sigma2", "tau2")
    )
    packed = variance.select(F.struct("grand_mean", "sigma2", "tau2").alias("v")).scalar()
    shrink = F.try_divide(n * F.col("_p.tau2"), n * F.col("_p.tau2") + F.col("_p.sigma2"))
    offsets = (
        units.withColumn("_p", packed)
        .withColumn("shrink", F.coalesce(shrink, F.lit(0.0)))
        .select(
            unit, "n", "mean", "shrink", (F.col("shrink") * (mean - F.col("_p.grand_mean"))).alias("offset")
        )
    )
    return variance, offsets


def fit_mixed_moments(
    df: DataFrame, panels: Sequence[str], unit: str, x: str, y: str, degree: int = 2
) -> MomentFit:
    """Polynomial per panel by least squares, unit offsets from its residuals."""
    coefs = stored(grouped_poly(df, panels, x, y, degree))
    table = coefs.select(*panels, *[f"b{i}" for i in range(degree + 1)])
    rows = attach(df.select(*panels, unit, x, y), table, panels)
    resid = rows.withColumn("_r", F.col(y) - fitted(F.col(x).cast("double"), degree))
    variance, offsets = one_way_moments(resid, unit, "_r")
    return MomentFit(list(panels), unit, degree, coefs, variance, offsets)


def predict_mixed_moments(fit: MomentFit, low: float, high: float, n: int) -> DataFrame:
    """(unit, panels, x, fixed_pred, unit_pred) on a grid.

    Units and panels may be many; each unit meets the panels in buckets.
    """
    b = [f"b{i}" for i in range(fit.degree + 1)]
    curves = beside_all(fit.offsets.select(fit.unit, "offset"), fit.coefs.select(*fit.panels, *b))
    points = curves.withColumn("x", F.explode(sequence_points(low, high, n)))
    fixed = fitted(F.col("x"), fit.degree)
    return points.select(
        fit.unit, *fit.panels, "x", fixed.alias("fixed_pred"), (fixed + F.col("offset")).alias("unit_pred")
    )


# --- likelihood form -------------------------------------------------------


@dataclass
class MixedFit:
    """Restricted-likelihood fit; `units` holds the per-unit matrices."""

    design: Design
    unit: str
    random: list[int]
    random_names: list[str]
    units: DataFrame
    n: int
    n_units: int
    theta: np.ndarray
    loglik: float
    sigma2: float
    beta: np.ndarray
    beta_cov: np.ndarray
    converged: bool
    factor_types: Mapping[str, str]

    @property
    def covariance(self) -> np.ndarray:
        """Covariance of the random terms (standardised x)."""
        lam = _factor(self.theta, len(self.random))
        return self.sigma2 * lam @ lam.T

    @property
    def singular(self) -> bool:
        """True when the random covariance has (nearly) lost a dimension."""
        lam = _factor(self.theta, len(self.random))
        values = np.linalg.eigvalsh(lam @ lam.T)
        return bool(values[0] < 1e-4 * max(values[-1], 1e-12))


def _factor(theta: np.ndarray, q: int) -> np.ndarray:
    lam = np.zeros((q, q))
    lam[np.tril_indices(q)] = theta
    return lam


def _unit_batch(pdf: pd.DataFrame, p: int, q: int) -> tuple[np.ndarray, ...]:
    def stack(name: str, *shape: int) -> np.ndarray:
        return np.stack([np.asarray(v, dtype=float) for v in pdf[name]]).reshape(-1, *shape)

    return (
        stack("xx", p, p),
        stack("xy", p),
        pdf["yy"].to_numpy(dtype=float),
        stack("zz", q, q),
        stack("zx", q, p),
        stack("zy", q),
    )


def unit_matrices(
    df: DataFrame, design: Design, unit: str, y: str, random: Sequence[int]
) -> DataFrame:
    """One row per unit with the products of fixed and random columns.

    The rows are combined to (unit, factor cell) moments before the shuffle. These
    cells, at most one per combination of factor levels and unit, are then brought
    together by unit and turned into matrices a batch of units at a time.
    """
    m, p = len(design.powers()), len(design.columns())
    random, factors = list(random), list(design.factors)
    slice_units = max(1, 2_000_000 // (p * p))

    def combine(pdf: pd.DataFrame, maps: dict) -> pd.DataFrame:
        for cell in set(zip(*[pdf[f] for f in factors], strict=True)) - set(maps) if factors else ():
            maps[cell] = design.cell_map(dict(zip(factors, cell, strict=True)))
        if factors:
            a = np.stack([maps[cell] for cell in zip(*[pdf[f] for f in factors], strict=True)])
        else:
            a = np.repeat(design.cell_map({})[None], len(pdf), axis=0)
        mm = np.zeros((len(pdf), m, m))
        upper = np.triu_indices(m)
        mm[:, upper[0], upper[1]] = np.stack(pdf["mm"].to_numpy())
        mm[:, upper[1], upper[0]] = mm[:, upper[0], upper[1]]
        my = np.stack(pdf["my"].to_numpy())
        names = pdf[unit].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        total = lambda v: np.add.reduceat(v, starts, axis=0)
        am = np.einsum("rpm,rmn->rpn", a, mm)
        xx, zx = total(np.einsum("rpn,rqn->rpq", am, a)), total(am.transpose(0, 2, 1))
        flat = lambda v: list(v.reshape(len(starts), -1))
        return pd.DataFrame(
            {
                unit: names[starts],
                "n": total(pdf["n"].to_numpy()),
                "xx": flat(xx),
                "xy": flat(total(np.einsum("rpm,rm->rp", a, my))),
                "yy": total(np.stack(pdf["yy"].to_numpy())[:, 0]),
                "zz": flat(total(mm)[:, random][:, :, random]),
                "zx": flat(zx[:, random]),
                "zy": flat(total(my)[:, random]),
            }
        )

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maps: dict = {}
        rest = None  # the last unit of a batch may go on in the next
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if len(pdf) == 0:
                continue
            last = (pdf[unit] == pdf[unit].iloc[-1]).to_numpy()
            rest, whole = pdf[last], pdf[~last]
            codes = pd.factorize(whole[unit])[0] // slice_units
            for _, part in whole.groupby(codes):
                yield combine(part, maps)
        if rest is not None and len(rest):
            yield combine(rest, maps)

    a = "array<double>"
    schema = f"`{unit}` {dict(df.dtypes)[unit]}, n bigint, xx {a}, xy {a}, yy double, zz {a}, zx {a}, zy {a}"
    cells = spread_out(cell_moments(df, design, [y], [unit]), unit)
    return cells.sortWithinPartitions(unit).mapInPandas(stream, schema)


def _unit_features(batch: tuple[np.ndarray, ...], q: int) -> np.ndarray:
    """(pair of random terms, unit, products): what a pair of random terms takes off X'X, X'y and y'y.

    With M = L (L'Z'ZL + 1)^-1 L' these are X'V^-1 X = X'X - X'Z M Z'X and so on, linear in M.
    """
    *_, zx, zy = batch
    z = np.concatenate([zx, zy[:, :, None]], axis=2)
    upper = np.triu_indices(z.shape[2])
    out = []
    for i in range(q):
        for j in range(i + 1):
            both = z[:, i, upper[0]] * z[:, j, upper[1]]
            out.append(both if i == j else both + z[:, j, upper[0]] * z[:, i, upper[1]])
    return np.stack(out)


def _unit_weights(zz: np.ndarray, lams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log determinants (candidate, unit) and the lower triangle of M (pair, candidate, unit)."""
    c, u, q = len(lams), len(zz), lams.shape[1]
    around = np.einsum("cki,clj->cijkl", lams, lams).reshape(c * q * q, q * q)
    w = (around @ zz.reshape(u, q * q).T).reshape(c, q, q, u)
    chol = np.zeros((q, q, c, u))
    for i in range(q):  # the factor of every L'Z'ZL + 1 at once
        for j in range(i + 1):
            s = w[:, i, j] + (1.0 if i == j else 0.0)
            for k in range(j):
                s = s - chol[i, k] * chol[j, k]
            chol[i, j] = np.sqrt(s) if i == j else s / chol[j, j]
    half = np.zeros((q, q, c, u))  # its inverse times L'
    for i in range(q):
        for j in range(q):
            s = np.broadcast_to(lams[:, j, i, None], (c, u))
            for k in range(i):
                s = s - chol[i, k] * half[k, j]
            half[i, j] = s / chol[i, i]
    logdet = 2 * sum(np.log(chol[i, i]) for i in range(q))
    return logdet, np.stack([(half[:, i] * half[:, j]).sum(axis=0) for i in range(q) for j in range(i + 1)])


def _sums(units: DataFrame, thetas: np.ndarray, p: int, q: int) -> np.ndarray:
    """For each candidate theta the sums over units, in one Spark job.

    A unit meets all candidates in one matrix product: its share of the sums is linear in the
    few weights that a candidate gives to pairs of its random terms.
    """
    width = 1 + p * p + p + 1
    lams = np.stack([_factor(np.asarray(t, dtype=float), q) for t in thetas])
    rows, columns = np.triu_indices(p + 1)

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, logdets, taken = np.zeros((p + 1, p + 1)), np.zeros(len(lams)), np.zeros((len(lams), len(rows)))
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                batch = _unit_batch(pdf.iloc[at : at + 1000], p, q)
                xx, xy, yy, zz, _, _ = batch
                whole[:p, :p] += xx.sum(axis=0)
                whole[:p, p] += xy.sum(axis=0)
                whole[p, p] += yy.sum()
                logdet, weights = _unit_weights(zz, lams)
                logdets += logdet.sum(axis=1)
                taken += (weights @ _unit_features(batch, q)).sum(axis=0)
        out = np.zeros((len(lams), width))
        for c in range(len(lams)):
            left = np.zeros((p + 1, p + 1))
            left[rows, columns] = whole[rows, columns] - taken[c]
            left = np.triu(left) + np.triu(left, 1).T
            out[c] = np.concatenate([[logdets[c]], left[:p, :p].ravel(), left[:p, p], [left[p, p]]])
        yield pd.DataFrame({"i": np.arange(out.size), "v": out.ravel()})

    summed = units.mapInPandas(evaluate, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.zeros(len(lams) * width)
    for row in summed.collect():
        flat[row["i"]] = row["v"]
    return flat.reshape(len(lams), width)


def _profile(sums: np.ndarray, n: int, p: int) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Restricted log-likelihood with beta and sigma2 profiled out."""
    logdet, xvx = sums[0], sums[1 : 1 + p * p].reshape(p, p)
    xvy, yvy = sums[1 + p * p : -1], sums[-1]
    scale = np.sqrt(np.diag(xvx))
    chol = np.linalg.cholesky(xvx / np.outer(scale, scale))
    beta = np.linalg.solve(chol.T, np.linalg.solve(chol, xvy / scale)) / scale
    rss = yvy - xvy @ beta
    dof = n - p
    logdet_x = 2 * np.log(np.diag(chol)).sum() + 2 * np.log(scale).sum()
    deviance = logdet + logdet_x + dof * (1 + np.log(2 * np.pi * rss / dof))
    return -0.5 * float(deviance), float(rss / dof), beta, xvx


def _maximise(
    evaluate: Callable[[np.ndarray], np.ndarray], q: int, max_steps: int, tolerance: float
) -> tuple[np.ndarray, bool]:
    """Newton steps on the relative covariance factor.

    Starts from the best of some multiples of the identity. One call of `evaluate`
    takes the step lengths along the current direction together with the difference
    stencil around the full step, which is the usual winner, so that a step normally
    costs one job over the units.
    """
    size = q * (q + 1) // 2
    identity = np.array([1.0 if i == j else 0.0 for i, j in zip(*np.tril_indices(q), strict=True)])
    scales = np.array([2.0, 1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01, 0.005])
    values = evaluate(scales[:, None] * identity)
    theta = scales[int(np.argmin(values))] * identity
    pairs = [(i, j) for i in range(size) for j in range(i)]
    lengths = np.array([1.0, 2.0, 0.5, 0.2, 0.05, 0.01, 0.001])

    def stencil(at: np.ndarray) -> tuple[np.ndarray, float]:
        h = 1e-2 * max(np.abs(at).max(), 1e-3)
        e = np.eye(size) * h
        return np.vstack([at, at + e, at - e, *[at + e[i] + e[j] for i, j in pairs]]), h

    def derivatives(v: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray]:
        up, down, both = v[1 : size + 1], v[size + 1 : 2 * size + 1], v[2 * size + 1 :]
        hessian = np.diag((up + down - 2 * v[0]) / h**2)
        for (i, j), f in zip(pairs, both, strict=True):
            hessian[i, j] = hessian[j, i] = (f - up[i] - up[j] + v[0]) / h**2
        return (up - down) / (2 * h), hessian

    points, h = stencil(theta)
    values = evaluate(points)
    for _ in range(max_steps):
        value = values[0]
        grad, hessian = derivatives(values, h)
        curvature, axes = np.linalg.eigh(hessian)
        floor = 1e-4 * max(np.abs(curvature).max(), 1e-8)
        direction = -axes @ ((axes.T @ grad) / np.maximum(np.abs(curvature), floor))
        reach = 2.0 * max(np.abs(theta).max(), 1e-3)
        direction *= min(1.0, reach / max(np.abs(direction).max(), 1e-300))
        points, h = stencil(theta + direction)
        tried = evaluate(np.vstack([theta + lengths[1:, None] * direction, points]))
        along = np.concatenate([[tried[len(lengths) - 1]], tried[: len(lengths) - 1]])
        best = int(np.argmin(along))
        if not along[best] < value - tolerance:
            if along[best] < value:
                theta = theta + lengths[best] * direction
            return theta, True
        theta = theta + lengths[best] * direction
        if best == 0:
            values = tried[len(lengths) - 1 :]
        else:
            points, h = stencil(theta)
            values = evaluate(points)
    return theta, False


def fit_mixed(
    df: DataFrame,
    y: str,
    terms: Sequence[Sequence[str]],
    unit: str,
    factors: Sequence[str] = (),
    numeric: Mapping[str, int | tuple[int, float, float]] | None = None,
    random: Sequence[Mapping[str, int]] = ({},),
    levels: Mapping[str, Sequence] | None = None,
    max_steps: int = 40,
    tolerance: float = 1e-6,
) -> MixedFit:
    """Fit by restricted maximum likelihood.

    `random` lists the random monomials per unit by covariate powers: `({},)` is a
    random intercept, `({}, {"x": 1}, {"x": 2})` a random quadratic. Covariates are
    standardised unless their centre and scale are given.
    """
    used = [unit, *factors, *(numeric or {}), y]
    rows = df.select(*dict.fromkeys(used)).dropna("any")
    design = build_design(rows, terms, factors, numeric, levels)
    monomials = design.powers()
    picked = [monomials.index({v: r.get(v, 0) for v in design.numeric}) for r in random]
    names = [
        "*".join(v if d == 1 else f"{v}^{d}" for v, d in r.items() if d) or "(intercept)" for r in random
    ]
    units = cut_lineage(unit_matrices(rows, design, unit, y, picked))
    count = units.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("u")).first()
    n, n_units = int(count["n"]), int(count["u"])
    p, q = len(design.columns()), len(picked)

    def evaluate(thetas: np.ndarray) -> np.ndarray:
        return np.array([-_profile(s, n, p)[0] for s in _sums(units, thetas, p, q)])

    theta, converged = _maximise(evaluate, q, max_steps, tolerance)
    loglik, sigma2, beta, xvx = _profile(_sums(units, theta[None], p, q)[0], n, p)
    return MixedFit(
        design, unit, picked, names, units, n, n_units, theta, loglik, sigma2,
        beta, sigma2 * np.linalg.pinv(xvx, hermitian=True), bool(converged), {v: dict(rows.dtypes)[v] for v in factors},
    )


def unit_effects(fit: MixedFit) -> DataFrame:
    """Predicted random terms per unit: (unit, u0, u1, ...)."""
    p, q = len(fit.design.columns()), len(fit.random)
    lam, beta, unit = _factor(fit.theta, q), fit.beta, fit.unit

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            _, _, _, zz, zx, zy = _unit_batch(pdf, p, q)
            middle = lam.T @ zz @ lam + np.eye(q)
            rhs = (zy - zx @ beta) @ lam
            u = np.linalg.solve(middle, rhs[:, :, None])[:, :, 0] @ lam.T
            yield pd.DataFrame({unit: pdf[unit], **{f"u{i}": u[:, i] for i in range(q)}})

    cols = ", ".join(f"u{i} double" for i in range(q))
    return fit.units.select(unit, "xx", "xy", "yy", "zz", "zx", "zy").mapInPandas(
        predict, f"`{unit}` {dict(fit.units.dtypes)[unit]}, {cols}"
    )


def predict_mixed(fit: MixedFit, grid: DataFrame) -> DataFrame:
    """Grid rows with fixed_pred (no random part) and unit_pred."""
    terms = zip(fit.design.column_expressions(), fit.beta, strict=True)
    fixed = sum((e * F.lit(float(b)) for e, b in terms), F.lit(0.0))
    monomials = fit.design.powers()
    offset = F.lit(0.0)
    for i, at in enumerate(fit.random):
        e = F.col(f"u{i}")
        for v, d in monomials[at].items():
            _, centre, scale = fit.design.numeric[v]
            for _ in range(d):
                e = e * ((F.col(v).cast("double") - F.lit(centre)) / F.lit(scale))
        offset = offset + F.coalesce(e, F.lit(0.0))
    rows = attach(grid, unit_effects(fit), [fit.unit]).withColumn("fixed_pred", fixed)
    return rows.withColumn("unit_pred", F.col("fixed_pred") + offset).drop(
        *[f"u{i}" for i in range(len(fit.random))]
    )


def _cell_coefficients(fit: MixedFit, x: str, cell: Mapping[str, object]) -> list[float]:
    """Constant, slope and bend of the fixed quadratic in x (standardised) in one factor cell."""
    coefs = [0.0, 0.0, 0.0]
    for (_, on, power), b in zip(fit.design.columns(), fit.beta, strict=True):
        if all(cell[v] == lev for v, lev in on.items()):
            coefs[power.get(x, 0)] += float(b)
    return coefs


def unit_vertices(fit: MixedFit, x: str, factors_at: Mapping[str, object]) -> DataFrame:
    """Vertex form (a, h, k) of each unit's predicted quadratic in one factor cell."""
    found = cell_vertices(fit, x)
    for v, lev in factors_at.items():
        found = found.where(F.col(v) == F.lit(lev))
    return found.select(fit.unit, "a", "h", "k")


def cell_vertices(fit: MixedFit, x: str) -> DataFrame:
    """(unit, factors, a, h, k): vertex form of each unit's predicted quadratic in every factor cell.

    Stands in for a mixed model written in vertex form, which is the same curve. A curve that is
    a line has null h and k.
    """
    monomials, factors = fit.design.powers(), list(fit.design.factors)
    _, centre, scale = fit.design.numeric[x]
    spark, types = fit.units.sparkSession, fit.factor_types
    cells = [dict(zip(factors, levels, strict=True)) for levels in product(*fit.design.factors.values())]
    schema = ", ".join([*(f"`{v}` {types[v]}" for v in factors), "_c0 double, _c1 double, _c2 double"])
    table = spark.createDataFrame([(*cell.values(), *_cell_coefficients(fit, x, cell)) for cell in cells], schema)
    rows = beside_all(unit_effects(fit), table)
    c = [F.col(f"_c{d}") for d in range(3)]
    for i, at in enumerate(fit.random):
        d = monomials[at].get(x, 0)
        c[d] = c[d] + F.col(f"u{i}")
    bend = F.when(c[2] != 0, c[2])
    return rows.select(
        fit.unit,
        *factors,
        (c[2] / F.lit(scale * scale)).alias("a"),
        (F.lit(centre) - F.lit(scale) * c[1] / (2 * bend)).alias("h"),
        (c[0] - c[1] * c[1] / (4 * bend)).alias("k"),
    )


def fixed_effects(spark, fit: MixedFit) -> DataFrame:
    """(term, estimate, std_error, statistic, converged)."""
    se = np.sqrt(np.diag(fit.beta_cov))
    rows = [
        (name, float(b), float(s), float(b / s), fit.converged)
        for name, b, s in zip(fit.design.names(), fit.beta, se, strict=True)
    ]
    return _table(spark, rows, "term string, estimate double, std_error double, statistic double, converged boolean")


def variance_table(spark, fit: MixedFit) -> DataFrame:
    """(component, value): log-likelihood, sigma2, the random covariance, and whether the fit is singular and has converged (0 or 1)."""
    rows = [("loglik", fit.loglik), ("sigma2", fit.sigma2), ("singular", float(fit.singular)), ("converged", float(fit.converged))]
    cov = fit.covariance
    for i, a in enumerate(fit.random_names):
        for j in range(i + 1):
            rows.append((f"cov[{a},{fit.random_names[j]}]", float(cov[i, j])))
    return _table(spark, rows, "component string, value double")


def likelihood_ratio(spark, smaller: MixedFit, larger: MixedFit) -> DataFrame:
    """Test of the random terms that only the larger fit has (same fixed part)."""
    df = len(larger.theta) - len(smaller.theta)
    chi2 = max(2 * (larger.loglik - smaller.loglik), 0.0)
    rows = [(smaller.loglik, larger.loglik, df, chi2, chi2_tail(chi2, df), smaller.converged and larger.converged)]
    return _table(
        spark,
        rows,
        "loglik_small double, loglik_large double, df int, chi2 double, p_value double, converged boolean",
    )


def wald_tests(spark, fit: MixedFit) -> DataFrame:
    """Marginal Wald F per term with containment denominator degrees of freedom.

    A term made only of covariates that also vary at random between units is tested
    against the units, every other term against the residual. No small-sample
    correction of the covariance is made.
    """
    design, p = fit.design, len(fit.design.columns())
    random_covariates = {v for at in fit.random for v, d in design.powers()[at].items() if d}
    rows = []
    for t, term in enumerate(design.terms):
        higher = {u for u, o in enumerate(design.terms) if u != t and set(term) < set(o)}
        keep = _columns_of(design, set(range(len(design.terms))) - higher)
        own = [i for i, (u, _, _) in enumerate(design.columns()) if u == t]
        inverse = np.linalg.pinv(fit.beta_cov, hermitian=True)
        inside = np.linalg.pinv(inverse[np.ix_(keep, keep)], hermitian=True)
        beta = inside @ (inverse @ fit.beta)[keep]
        at = [keep.index(i) for i in own]
        b = beta[at]
        f = float(b @ np.linalg.pinv(inside[np.ix_(at, at)], hermitian=True) @ b) / len(own)
        if set(term) <= random_covariates:
            den = fit.n_units - 1
        else:
            den = fit.n - p - (fit.n_units - 1) * len(fit.random)
        den = max(den, 1)
        rows.append((":".join(term), len(own), den, f, f_tail(f, len(own), den), fit.converged))
    return _table(
        spark, rows, "term string, num_df int, den_df int, f_value double, p_value double, converged boolean"
    )
