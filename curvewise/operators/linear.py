"""Factorial linear models with covariates, polynomials and interactions.

The rows are reduced by one Spark aggregation to moments per factor cell. The cells
are turned into pieces of X'X and X'Y inside tasks and summed by Spark; what reaches
the driver is one p x p system, p being the number of model columns. Everything else
(coefficients, tests, effect sizes) is derived from that system without going back
to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvewise.functions.tails import f_tail, t_quantile, t_tail


def crossed(*variables: str, order: int | None = None) -> list[tuple[str, ...]]:
    """Main effects and interactions up to `order` (all of them by default)."""
    top = order or len(variables)
    return [c for k in range(1, top + 1) for c in combinations(variables, k)]


@dataclass(frozen=True)
class Design:
    """Columns of a model: an intercept, then the columns of each term.

    `factors` maps a factor to its levels, the first being the baseline of the
    treatment contrasts. `numeric` maps a covariate to its polynomial degree, centre
    and scale; powers are taken of (value - centre) / scale.
    """

    factors: Mapping[str, tuple]
    numeric: Mapping[str, tuple[int, float, float]]
    terms: tuple[tuple[str, ...], ...]

    def powers(self) -> list[dict[str, int]]:
        """All monomials of the covariates, the constant first."""
        names = list(self.numeric)
        ranges = [range(self.numeric[v][0] + 1) for v in names]
        return [dict(zip(names, p, strict=True)) for p in product(*ranges)]

    def columns(self) -> list[tuple[int, dict[str, object], dict[str, int]]]:
        """(term index, factor levels switched on, covariate powers); intercept is -1."""
        out: list = [(-1, {}, {})]
        for t, term in enumerate(self.terms):
            choices = [
                [(v, lev) for lev in self.factors[v][1:]]
                if v in self.factors
                else [(v, d) for d in range(1, self.numeric[v][0] + 1)]
                for v in term
            ]
            for picked in product(*choices):
                on = {v: x for v, x in picked if v in self.factors}
                power = {v: x for v, x in picked if v in self.numeric}
                out.append((t, on, power))
        return out

    def names(self) -> list[str]:
        out = []
        for t, on, power in self.columns():
            parts = [
                f"{v}[{on[v]}]" if v in on else (v if power[v] == 1 else f"{v}^{power[v]}")
                for v in (self.terms[t] if t >= 0 else ())
            ]
            out.append(":".join(parts) or "(intercept)")
        return out

    def column_expressions(self) -> list[Column]:
        """Each design column as a Spark expression on the variables."""
        out = []
        for _, on, power in self.columns():
            e = F.lit(1.0)
            for v, lev in on.items():
                e = e * F.when(F.col(v) == F.lit(lev), F.lit(1.0)).otherwise(F.lit(0.0))
            for v, d in power.items():
                _, centre, scale = self.numeric[v]
                for _ in range(d):
                    e = e * ((F.col(v).cast("double") - F.lit(centre)) / F.lit(scale))
            out.append(e)
        return out

    def matrix(self, pdf: pd.DataFrame) -> np.ndarray:
        """Design matrix of a pandas batch."""
        cols = []
        for _, on, power in self.columns():
            c = np.ones(len(pdf))
            for v, lev in on.items():
                c = c * (pdf[v] == lev).to_numpy(dtype=float)
            for v, d in power.items():
                _, centre, scale = self.numeric[v]
                c = c * ((pdf[v].to_numpy(dtype=float) - centre) / scale) ** d
            cols.append(c)
        return np.column_stack(cols)

    def cell_map(self, cell: Mapping[str, object]) -> np.ndarray:
        """p x m matrix: how the monomials make up the design columns in one cell."""
        monomials = self.powers()
        cols = self.columns()
        out = np.zeros((len(cols), len(monomials)))
        for i, (_, on, power) in enumerate(cols):
            if all(cell[v] == lev for v, lev in on.items()):
                full = {v: power.get(v, 0) for v in self.numeric}
                out[i, monomials.index(full)] = 1.0
        return out


def build_design(
    df: DataFrame,
    terms: Sequence[Sequence[str]],
    factors: Sequence[str] = (),
    numeric: Mapping[str, int | tuple[int, float, float]] | None = None,
    levels: Mapping[str, Sequence] | None = None,
) -> Design:
    """Find factor levels and covariate centres in one aggregation over the rows.

    A covariate is given by its degree, or by (degree, centre, scale) to fix them. Only the
    levels of each factor come to the driver, which has a model column for each of them
    anyway; factors with more levels than a system of equations can have columns are absorbed
    instead (`absorbing`).
    """
    numeric = dict(numeric or {})
    given = dict(levels or {})
    searched = [f for f in factors if not given.get(f)]
    free = [v for v, degree in numeric.items() if not isinstance(degree, tuple)]
    parts = [F.collect_set(f).alias(f"_l_{f}") for f in searched]
    parts += [e for v in free for e in (F.avg(v).alias(f"_m_{v}"), F.stddev_pop(v).alias(f"_s_{v}"))]
    row = df.agg(*parts).first() if parts else {}
    found = {f: tuple(given.get(f) or sorted(row[f"_l_{f}"])) for f in factors}
    scales = {v: (numeric[v], float(row[f"_m_{v}"] or 0.0), float(row[f"_s_{v}"] or 0.0) or 1.0) if v in free else numeric[v] for v in numeric}
    return Design(found, scales, tuple(tuple(t) for t in terms))


def cell_moments(
    df: DataFrame, design: Design, ys: Sequence[str], extra_keys: Sequence[str] = ()
) -> DataFrame:
    """Per factor cell: products of the monomials and responses, as one array each.

    `mm` are the upper products of monomials, `my` monomial x response, `yy` the
    upper products of responses.
    """
    monomials = []
    for p in design.powers():
        e = F.lit(1.0)
        for v, d in p.items():
            _, centre, scale = design.numeric[v]
            z = (F.col(v).cast("double") - F.lit(centre)) / F.lit(scale)
            for _ in range(d):
                e = e * z
        monomials.append(e)
    keys = [*extra_keys, *design.factors]
    rows = df.select(
        *keys,
        *[e.alias(f"_t{i}") for i, e in enumerate(monomials)],
        *[F.col(y).cast("double").alias(f"_y{i}") for i, y in enumerate(ys)],
    )
    m, k = len(monomials), len(ys)
    prod = lambda a, b: F.sum(F.col(a) * F.col(b))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[prod(f"_t{i}", f"_t{j}") for i in range(m) for j in range(i, m)]).alias("mm"),
        F.array(*[prod(f"_t{i}", f"_y{j}") for i in range(m) for j in range(k)]).alias("my"),
        F.array(*[prod(f"_y{i}", f"_y{j}") for i in range(k) for j in range(i, k)]).alias("yy"),
    )


def unpack_upper(values: Sequence[float], m: int) -> np.ndarray:
    out = np.zeros((m, m))
    out[np.triu_indices(m)] = values
    return out + out.T - np.diag(np.diag(out))


def cell_systems(design: Design, pdf: pd.DataFrame, m: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """X'X, X'Y and Y'Y summed over the factor cells of a batch."""
    cols, monomials = design.columns(), design.powers()
    on = np.ones((len(pdf), len(cols)))
    for i, (_, levels, _) in enumerate(cols):
        for v, lev in levels.items():
            on[:, i] *= (pdf[v] == lev).to_numpy(dtype=float)
    part = np.array([monomials.index({v: power.get(v, 0) for v in design.numeric}) for _, _, power in cols])
    mm = np.zeros((len(pdf), m, m))
    upper = np.triu_indices(m)
    mm[:, upper[0], upper[1]] = np.array(pdf["mm"].tolist(), float).reshape(len(pdf), -1)
    mm[:, upper[1], upper[0]] = mm[:, upper[0], upper[1]]
    my = np.array(pdf["my"].tolist(), float).reshape(len(pdf), m, k)
    yy = unpack_upper(np.array(pdf["yy"].tolist(), float).reshape(len(pdf), -1).sum(axis=0), k)
    xtx, xty = np.zeros((len(cols), len(cols))), np.zeros((len(cols), k))
    for a in range(m):
        mine = np.flatnonzero(part == a)
        xty[mine] = on[:, mine].T @ my[:, a]
        for b in range(m):
            other = np.flatnonzero(part == b)
            xtx[np.ix_(mine, other)] = on[:, mine].T @ (mm[:, a, b, None] * on[:, other])
    return xtx, xty, yy


@dataclass
class LinearFit:
    """A solved linear model; all products are of the whole table."""

    design: Design
    ys: list[str]
    n: int
    xtx: np.ndarray
    xty: np.ndarray
    yty: np.ndarray
    beta: np.ndarray = field(init=False)
    rank: int = field(init=False)

    def __post_init__(self) -> None:
        self.beta, self.rank = solve(self.xtx, self.xty)

    def residual(self, keep: Sequence[int] | None = None) -> tuple[np.ndarray, int]:
        """Residual SSP matrix and rank of the model with only some columns."""
        idx = np.arange(len(self.xtx)) if keep is None else np.asarray(keep, dtype=int)
        beta, rank = solve(self.xtx[np.ix_(idx, idx)], self.xty[idx])
        return self.yty - beta.T @ self.xty[idx], rank

    @property
    def df_resid(self) -> int:
        return self.n - self.rank

    @property
    def sse(self) -> float:
        return float(self.residual()[0][0, 0])

    def covariance(self) -> np.ndarray:
        return np.linalg.pinv(self.xtx, hermitian=True) * self.sse / self.df_resid


def solve(xtx: np.ndarray, xty: np.ndarray) -> tuple[np.ndarray, int]:
    """Least squares from the normal equations, scaled; aliased columns share weight."""
    if len(xtx) == 0:
        return np.zeros((0, xty.shape[1])), 0
    s = np.sqrt(np.where(np.diag(xtx) > 0, np.diag(xtx), 1.0))
    inverse = np.linalg.pinv(xtx / np.outer(s, s), rcond=1e-10, hermitian=True)
    rank = int(np.linalg.matrix_rank(xtx / np.outer(s, s), tol=1e-10 * len(xtx), hermitian=True))
    return (inverse @ (xty / s[:, None])) / s[:, None], rank


def complete_for(df: DataFrame, design: Design, ys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    names = [*extra, *design.factors, *design.numeric, *ys]
    return df.select(*dict.fromkeys(names)).dropna("any")


def fit_linear(
    df: DataFrame,
    ys: str | Sequence[str],
    terms: Sequence[Sequence[str]],
    factors: Sequence[str] = (),
    numeric: Mapping[str, int | tuple[int, float, float]] | None = None,
    levels: Mapping[str, Sequence] | None = None,
) -> LinearFit:
    """Fit one or several responses on the same terms; incomplete rows are left out."""
    responses = [ys] if isinstance(ys, str) else list(ys)
    used = [*factors, *(numeric or {}), *responses]
    rows = df.select(*dict.fromkeys(used)).dropna("any")
    design = build_design(rows, terms, factors, numeric, levels)
    cells = cell_moments(rows, design, responses)
    m, k, p = len(design.powers()), len(responses), len(design.columns())

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xtx, xty, yty, n = np.zeros((p, p)), np.zeros((p, k)), np.zeros((k, k)), 0
        for pdf in batches:
            if len(pdf):
                a, b, c = cell_systems(design, pdf, m, k)
                xtx, xty, yty, n = xtx + a, xty + b, yty + c, n + pdf["n"].sum()
        flat = np.concatenate([xtx.ravel(), xty.ravel(), yty.ravel(), [n]])
        yield pd.DataFrame({"i": np.arange(len(flat)), "v": flat})

    summed = cells.mapInPandas(pieces, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.zeros(p * p + p * k + k * k + 1)
    for row in summed.collect():
        flat[row["i"]] = row["v"]
    cut = np.cumsum([p * p, p * k, k * k])
    return LinearFit(
        design,
        responses,
        int(round(flat[-1])),
        flat[: cut[0]].reshape(p, p),
        flat[cut[0] : cut[1]].reshape(p, k),
        flat[cut[1] : cut[2]].reshape(k, k),
    )


def _table(spark, rows: list[tuple], schema: str) -> DataFrame:
    clean = [tuple(v.item() if isinstance(v, np.generic) else v for v in r) for r in rows]
    return spark.createDataFrame(clean, schema)


def tidy(spark, fit: LinearFit) -> DataFrame:
    """(term, estimate, std_error, statistic, p_value) of the first response."""
    se = np.sqrt(np.maximum(np.diag(fit.covariance()), 0.0))
    rows = []
    for name, b, s in zip(fit.design.names(), fit.beta[:, 0], se, strict=True):
        t = b / s if s > 0 else None
        rows.append((name, b, s, t, None if t is None else t_tail(t, fit.df_resid)))
    return _table(
        spark, rows, "term string, estimate double, std_error double, statistic double, p_value double"
    )


def _columns_of(design: Design, terms: set[int]) -> list[int]:
    return [i for i, (t, _, _) in enumerate(design.columns()) if t in terms or t == -1]


def _marginal_pairs(design: Design) -> Iterator[tuple[int, set[int], set[int]]]:
    """For each term: the terms of the smaller and of the larger model to compare.

    Both leave out every term that contains the tested one.
    """
    for t, term in enumerate(design.terms):
        higher = {u for u, other in enumerate(design.terms) if u != t and set(term) < set(other)}
        larger = set(range(len(design.terms))) - higher
        yield t, larger - {t}, larger


ANOVA_SCHEMA = (
    "term string, df int, sum_sq double, f_value double, p_value double, mse double, total_ss double"
)


def _anova(spark, fit: LinearFit, blocks: list[tuple[str, float, int]]) -> DataFrame:
    mse = fit.sse / fit.df_resid
    total = float(fit.residual([0])[0][0, 0])
    rows = []
    for name, ss, df in blocks:
        f = ss / df / mse if df > 0 and mse > 0 else None
        p = None if f is None else f_tail(f, df, fit.df_resid)
        rows.append((name, df, ss, f, p, mse, total))
    rows.append(("Residuals", fit.df_resid, fit.sse, None, None, mse, total))
    return _table(spark, rows, ANOVA_SCHEMA)


def anova_marginal(spark, fit: LinearFit) -> DataFrame:
    """Type II table: each term after all terms that do not contain it."""
    blocks = []
    for t, smaller, larger in _marginal_pairs(fit.design):
        sse0, r0 = fit.residual(_columns_of(fit.design, smaller))
        sse1, r1 = fit.residual(_columns_of(fit.design, larger))
        blocks.append((":".join(fit.design.terms[t]), float((sse0 - sse1)[0, 0]), r1 - r0))
    return _anova(spark, fit, blocks)


def anova_sequential(spark, fit: LinearFit) -> DataFrame:
    """Type I table: each term after the terms written before it."""
    blocks, seen = [], set()
    sse0, r0 = fit.residual(_columns_of(fit.design, seen))
    for t, term in enumerate(fit.design.terms):
        seen = seen | {t}
        sse1, r1 = fit.residual(_columns_of(fit.design, seen))
        blocks.append((":".join(term), float((sse0 - sse1)[0, 0]), r1 - r0))
        sse0, r0 = sse1, r1
    return _anova(spark, fit, blocks)


def effect_sizes(anova: DataFrame) -> DataFrame:
    """Partial eta squared and omega squared per term of an analysis of variance."""
    resid = F.col("mse")
    sse = anova.where(F.col("term") == "Residuals").agg(F.max("sum_sq")).scalar()
    terms = anova.withColumn("_sse", sse).where(F.col("term") != "Residuals")
    return terms.select(
        "term",
        "df",
        "sum_sq",
        F.try_divide(F.col("sum_sq"), F.col("sum_sq") + F.col("_sse")).alias("eta_sq"),
        F.try_divide(F.col("sum_sq") - F.col("df") * resid, F.col("total_ss") + resid).alias("omega_sq"),
    )


def predict_linear(fit: LinearFit, grid: DataFrame, level: float | None = None) -> DataFrame:
    """Fitted values on the rows of a grid; with `level` also se, lower and upper."""
    if level is None:
        terms = zip(fit.design.column_expressions(), fit.beta[:, 0], strict=True)
        value = sum((e * F.lit(float(b)) for e, b in terms), F.lit(0.0))
        return grid.withColumn("fit", value)
    width = F.lit(t_quantile(level, fit.df_resid))
    values, axes = np.linalg.eigh(fit.covariance())
    known = values > 0
    roots = (axes[:, known] * np.sqrt(values[known])).T  # the variance is the squared length of roots times the design row

    def dot(row: Column, other: Column) -> Column:
        return F.aggregate(F.zip_with(row, other, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)

    vectors = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in roots])
    beta = F.array(*[F.lit(float(b)) for b in fit.beta[:, 0]])
    parts = F.transform(vectors, lambda row: dot(row, F.col("_design")))
    rows = grid.withColumn("_design", F.array(*fit.design.column_expressions()))
    rows = rows.withColumns({"fit": dot(beta, F.col("_design")), "se": F.sqrt(dot(parts, parts))}).drop("_design")
    return rows.withColumns({"lower": F.col("fit") - width * F.col("se"), "upper": F.col("fit") + width * F.col("se")})


def augment_linear(fit: LinearFit, df: DataFrame) -> DataFrame:
    """Rows with fitted value and residual."""
    y = fit.ys[0]
    rows = predict_linear(fit, complete_for(df, fit.design, [y]))
    return rows.withColumn("resid", F.col(y) - F.col("fit"))


def aic_linear(fit: LinearFit) -> float:
    return fit.n * float(np.log(fit.sse / fit.n)) + 2 * (fit.rank + 1)


def manova(spark, fit: LinearFit) -> DataFrame:
    """Pillai trace per term (marginal) with its approximate F test."""
    error, _ = fit.residual()
    k = len(fit.ys)
    rows = []
    for t, smaller, larger in _marginal_pairs(fit.design):
        e0, r0 = fit.residual(_columns_of(fit.design, smaller))
        e1, r1 = fit.residual(_columns_of(fit.design, larger))
        h, q = e0 - e1, r1 - r0
        trace = float(np.trace(h @ np.linalg.pinv(h + error, hermitian=True)))
        s = min(k, q)
        if s > 0:
            m, w = (abs(k - q) - 1) / 2, (fit.df_resid - k - 1) / 2
            df1, df2 = s * (2 * m + s + 1), s * (2 * w + s + 1)
            f = (2 * w + s + 1) / (2 * m + s + 1) * trace / (s - trace)
            rows.append((":".join(fit.design.terms[t]), q, trace, f, df1, df2, f_tail(f, df1, df2)))
    return _table(
        spark,
        rows,
        "term string, df int, pillai double, f_value double, num_df double, den_df double, p_value double",
    )
