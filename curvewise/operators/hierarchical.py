"""A common smooth, a smooth per group around it and group offsets, from one penalised fit.

The model is y = f(x) + f_g(x) + u_g + e with the same hinge basis for f and f_g. Its normal
equations are bordered: every group meets the common coefficients, no two groups meet. Rows are
summed once to the products of the basis per group; a task then eliminates the coefficients of
all its groups at a time and sends sums as wide as the basis, so that neither the number of
groups nor that of rows reaches the driver. Effective numbers of parameters and residual sums
come from the same sums, for a whole lattice of penalties in one pass.

Penalties do not depend on the amount of data: the common one is `common` times all rows, that
of a group `group` times its rows, on a basis in units of the standard deviation of x. The common
smooth leaves its straight part free; the group smooths are shrunk whole, and offsets as random
effects with `offset`, the ratio of the residual to the offset variance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvewise.session import stored

LATTICE = (1e-4, 1e-3, 1e-2, 0.1, 1.0, 10.0)
OFFSETS = (0.1, 1.0, 10.0, 100.0)


@dataclass
class JointSmooth:
    """One fitted model.

    `groups` has a row per group: n, group (its penalty), edf and coefs, all relative to the
    common smooth; `coefs` are those of the common one.
    """

    keys: list[str]
    knots: list[float]
    centre: float
    spread: float
    level: float
    coefs: np.ndarray
    groups: DataFrame
    penalties: dict[str, float | None]
    n: int
    sse: float
    edf: float
    steps: int
    converged: bool

    @property
    def gcv(self) -> float:
        return self.n * self.sse / (self.n - self.edf) ** 2

    @property
    def aic(self) -> float:
        return self.n * float(np.log(self.sse / self.n)) + 2 * self.edf


@dataclass
class _Sums:
    """What a pass brings to the driver, p being the width of the basis."""

    schur: np.ndarray
    right: np.ndarray
    shrunk: np.ndarray  # with the inverse of `schur`, what groups lose of their parameters
    bent: np.ndarray  # the residual sum is constant + slope'b + b'(bent)b in the common b
    slope: np.ndarray
    constant: float
    lost: float
    groups: int

    @classmethod
    def of(cls, flat: np.ndarray, p: int) -> _Sums:
        a, b = p * p, p * p + p
        square = [flat[i * a : (i + 1) * a].reshape(p, p) for i in range(3)]
        rest = flat[3 * a :]
        return cls(square[0], rest[:p], square[1], square[2], rest[p : 2 * p], *rest[2 * p : 2 * p + 2], int(rest[2 * p + 2]))

    def solve(self, penalty: np.ndarray) -> tuple[np.ndarray, float, float]:
        """Common coefficients, residual sum and effective parameters."""
        inverse = np.linalg.pinv(self.schur + penalty, hermitian=True)
        beta = inverse @ self.right
        p = len(beta)
        rank = np.linalg.matrix_rank(self.schur + penalty, hermitian=True)
        edf = rank + self.groups * p - np.trace(penalty @ inverse) - self.lost - np.trace(inverse @ self.shrunk)
        return beta, float(self.constant + self.slope @ beta + beta @ self.bent @ beta), float(edf)


def _size(p: int) -> int:
    return 3 * p * p + 2 * p + 3


def _basis(x: Column, knots: Sequence[float], centre: float, spread: float) -> list[Column]:
    x = x.cast("double")
    hinges = [F.greatest(x - F.lit(k), F.lit(0.0)) / F.lit(spread) for k in knots]
    return [F.lit(1.0), (x - F.lit(centre)) / F.lit(spread), *hinges]


def group_products(df: DataFrame, keys: Sequence[str], x: str, y: str, knots: Sequence[float]) -> tuple[DataFrame, tuple]:
    """n, products of the basis and of the response per group, with the centre and spread of x and the level of y."""
    rows = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna("any", subset=["_x", "_y"])
    n, centre, spread, level = rows.agg(F.count("_x"), F.avg("_x"), F.stddev_pop("_x"), F.avg("_y")).first()
    units = (int(n), float(centre or 0.0), float(spread or 1.0) or 1.0, float(level or 0.0))
    basis = _basis(F.col("_x"), [float(k) for k in knots], units[1], units[2])
    p = len(basis)
    rows = rows.select(*keys, (F.col("_y") - F.lit(units[3])).alias("_y"), *[b.alias(f"_b{i}") for i, b in enumerate(basis)])
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col(f"_b{i}") * F.col(f"_b{j}")) for i in range(p) for j in range(p)]).alias("xx"),
        F.array(*[F.sum(F.col(f"_b{i}") * F.col("_y")) for i in range(p)]).alias("xy"),
        F.sum(F.col("_y") * F.col("_y")).alias("yy"),
    )
    return sums, units


class _Groups:
    """Products of the groups of a batch, stacked."""

    def __init__(self, pdf: pd.DataFrame, p: int):
        self.n = pdf["n"].to_numpy(float)
        self.gram = np.array(pdf["xx"].tolist(), float).reshape(-1, p, p)
        self.right = np.array(pdf["xy"].tolist(), float).reshape(-1, p)
        self.yy = pdf["yy"].to_numpy(float)
        self.p = p

    def penalties(self, group: float | np.ndarray, offset: float) -> np.ndarray:
        """The diagonal of each group's penalty."""
        out = np.repeat((self.n * group)[:, None], self.p, 1)
        out[:, 0] = offset
        return out

    def inverse(self, penalty: np.ndarray) -> np.ndarray:
        return np.linalg.inv(self.gram + penalty[:, :, None] * np.eye(self.p))

    def chosen(self, beta: np.ndarray, lattice: Sequence[float], offset: float, variance: float) -> np.ndarray:
        """Each group's own penalty: the largest likelihood of its residuals from the common smooth.

        The penalty is read as the precision of normal coefficients. Solving for the common
        smooth lowers the same criterion, so that taking turns cannot go round in a circle.
        """
        gap = self.gram @ beta
        right, yy = self.right - gap, self.yy - 2 * self.right @ beta + gap @ beta
        best, score = np.full(self.n.size, max(lattice)), np.full(self.n.size, np.inf)
        for value in sorted(lattice, reverse=True):
            penalty = self.penalties(value, offset)
            k = self.inverse(penalty)
            left = yy - np.einsum("gi,gij,gj->g", right, k, right)
            now = left / variance - np.linalg.slogdet(k)[1] - np.log(penalty).sum(1)
            better = now < score - 1e-9
            best[better], score[better] = value, now[better]
        return best

    def eliminated(self, penalty: np.ndarray) -> np.ndarray:
        """The sums of `_Sums` over these groups."""
        k = self.inverse(penalty)
        from_common = k @ self.gram
        alone = np.einsum("gij,gj->gi", k, self.right)
        stays = np.eye(self.p) - from_common  # a group's whole curve is alone + stays @ beta
        turned = np.swapaxes(stays, 1, 2)
        schur = (self.gram @ stays).sum(0)
        right = np.einsum("gji,gj->i", stays, self.right)
        shrunk = (np.swapaxes(from_common, 1, 2) @ (penalty[:, :, None] * from_common)).sum(0)
        bent = (turned @ self.gram @ stays).sum(0)
        gap = np.einsum("gij,gj->gi", self.gram, alone)
        slope = 2 * np.einsum("gji,gj->i", stays, gap - self.right)
        constant = (self.yy - 2 * (alone * self.right).sum(1) + (alone * gap).sum(1)).sum()
        lost = (penalty * np.diagonal(k, axis1=1, axis2=2)).sum()
        return np.concatenate([schur.ravel(), shrunk.ravel(), bent.ravel(), right, slope, [constant, lost, self.n.size]])


def _passes(products: DataFrame, p: int, count: int, penalties: Callable[[_Groups], list[np.ndarray]]) -> list[_Sums]:
    """Sums over all groups for `count` choices of penalties, in one pass over the products."""
    wide = _size(p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((count, wide))
        for pdf in batches:
            if len(pdf):
                groups = _Groups(pdf, p)
                total += np.array([groups.eliminated(v) for v in penalties(groups)])
        yield pd.DataFrame({"i": np.arange(count * wide), "v": total.ravel()})

    flat = np.zeros(count * wide)
    for row in products.select("n", "xx", "xy", "yy").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        flat[row["i"]] = row["v"]
    return [_Sums.of(part, p) for part in flat.reshape(count, wide)]


def _group_table(products: DataFrame, keys: Sequence[str], p: int, beta: np.ndarray, own: Callable[[_Groups], np.ndarray], offset: float) -> DataFrame:
    kinds = dict(products.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n bigint, `group` double, edf double, coefs array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            groups = _Groups(pdf, p)
            values = own(groups)
            k = groups.inverse(groups.penalties(values, offset))
            b = np.einsum("gij,gj->gi", k, groups.right - groups.gram @ beta)
            out = pdf[[*keys, "n"]].copy()
            out["group"], out["edf"], out["coefs"] = values, np.einsum("gij,gji->g", k, groups.gram), b.tolist()
            yield out

    return products.mapInPandas(run, schema)


def joint_smooth(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    knots: Sequence[float],
    wiggliness: str = "shared",
    common: Sequence[float] = LATTICE,
    group: Sequence[float] = LATTICE,
    offset: Sequence[float] = OFFSETS,
    steps: int = 30,
    tolerance: float = 1e-8,
) -> JointSmooth:
    """Fit the model, its penalties chosen on lattices by the generalised cross-validation score.

    With `wiggliness` "shared" all groups have one penalty, and one pass scores every
    combination. With "separate" each group has its own: given the common smooth, each takes
    that with the largest likelihood of its residuals, and the common smooth is solved again with
    them, until it stands still; `converged` tells whether it did within `steps`. Rows without x
    or y are left out; a null key is a group.
    """
    if wiggliness not in ("shared", "separate"):
        raise ValueError("wiggliness is shared or separate")
    keys, p = list(keys), len(knots) + 2
    sums, (n, centre, spread, level) = group_products(df, keys, x, y, knots)
    if not n:
        raise ValueError("no rows with x and y")
    products = stored(sums)
    bends = np.diag([0.0, 0.0] + [float(n)] * len(knots))
    choices = list(product(group, offset))
    found = _passes(products, p, len(choices), lambda g: [g.penalties(a, b) for a, b in choices])
    best = None
    for (a, b), part in zip(choices, found, strict=True):
        for c in common:
            beta, sse, edf = part.solve(c * bends)
            score = n * sse / (n - edf) ** 2 if n - edf > 1e-6 else np.inf
            if best is None or score < best[0] * (1 - 1e-12):
                best = (score, a, b, c, beta, sse, edf)
    _, a, b, c, beta, sse, edf = best
    taken, settled = 0, True
    own: Callable[[_Groups], np.ndarray] = lambda g, a=a: np.full(g.n.size, a)
    if wiggliness == "separate":
        settled, variance = False, sse / (n - edf)
        while taken < steps and not settled:
            own = lambda g, at=beta: g.chosen(at, group, b, variance)
            (part,) = _passes(products, p, 1, lambda g, own=own: [g.penalties(own(g), b)])
            before = beta
            beta, sse, edf = part.solve(c * bends)
            taken += 1
            settled = bool(np.abs(beta - before).max() <= tolerance * max(np.abs(beta).max(), 1e-12))
    table = _group_table(products, keys, p, beta, own, b)
    penalties = {"common": c, "group": a if wiggliness == "shared" else None, "offset": b}
    return JointSmooth(keys, [float(k) for k in knots], centre, spread, level, beta, table, penalties, n, sse, edf, taken, settled)


def joint_points(fit: JointSmooth, points: Column) -> DataFrame:
    """keys, x, common (the common smooth) and fit (the group's curve) at an array of x points."""
    x = F.col("x")
    basis = _basis(x, fit.knots, fit.centre, fit.spread)
    shared = sum((b * F.lit(float(c)) for b, c in zip(basis, fit.coefs, strict=True)), F.lit(fit.level))
    own = sum((b * F.col("coefs")[i] for i, b in enumerate(basis)), F.lit(0.0))
    rows = fit.groups.withColumn("x", F.explode(points))
    return rows.select(*fit.keys, "x", shared.alias("common"), (shared + own).alias("fit"))


def compare_wiggliness(df: DataFrame, keys: Sequence[str], x: str, y: str, knots: Sequence[float], **lattices) -> DataFrame:
    """(wiggliness, n, edf, sse, gcv, aic, steps, converged, best) of the shared and the separate model."""
    fits = {w: joint_smooth(df, keys, x, y, knots, w, **lattices) for w in ("shared", "separate")}
    best = min(fits, key=lambda w: fits[w].gcv)
    rows = [(w, f.n, f.edf, f.sse, f.gcv, f.aic, f.steps, f.converged, best) for w, f in fits.items()]
    return df.sparkSession.createDataFrame(
        rows, "wiggliness string, n bigint, edf double, sse double, gcv double, aic double, steps int, converged boolean, best string"
    )
