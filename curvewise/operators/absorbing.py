"""Linear models with factors of any number of levels, absorbed instead of given columns.

The response and the covariates are projected on the space of all factor levels and only their
residuals enter the normal equations, which are as wide as the covariates. The levels of the
first factor are eliminated exactly; those of the others solve the reduced equations by conjugate
gradients, all right sides at once. Effects, residuals and directions are tables with one row per
level. The rows are summed to factor combinations, which are sorted by the first factor into
blocks and stay there: a block is sent the directions of the levels that it holds and returns
its part of their product with the reduced matrix. The driver sees a few numbers per right side and step.

A level of the first factor that may reach into another block, the first and the last of each, is not
eliminated but solved for with the others, so a level of any size is shared out over blocks.

Rows with a missing factor, covariate or response are left out. A covariate that the factors
determine has no estimate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from curvewise.functions.tails import f_tail, t_tail
from curvewise.operators.linear import ANOVA_SCHEMA
from curvewise.session import stored

#: Of the sum of squares of a column, what is left of it by rounding.
NOTHING = 1e-24
#: Combinations that are worth a block of their own, and the most of a block. Between them there
#: are as many blocks as shuffle partitions, so that what is sent grows with the levels.
BLOCK_CELLS, MOST_CELLS = 500_000, 2_000_000


@dataclass
class Projection:
    """Columns of a table projected on the levels of factors.

    `cells` has a row per combination of levels (_f0, _f1, ..., whole numbers if all factors are, else
    text) with n, the sums _s0, _s1, ... of the columns and their projections _t0, _t1, ...; `levels`
    has the coefficients _v0, _v1, ... of the levels of all factors but the first.
    """

    factors: list[str]
    n: int
    means: np.ndarray
    products: np.ndarray  # of the columns around their means
    residual: np.ndarray  # of what the levels leave of them
    rank: int
    cells: DataFrame
    levels: DataFrame | None
    steps: int
    converged: bool
    first: Projection | None = None  # on the levels of the first factor alone


@dataclass
class Cells:
    """A table summed to combinations of levels: `table` with their n and sums around the means."""

    factors: list[str]
    n: int
    means: np.ndarray
    products: np.ndarray
    table: DataFrame

    def of(self, factors: Sequence[str]) -> Cells:
        """Combinations of some of the factors; without any, one cell."""
        keys = [F.col(f"_f{self.factors.index(c)}").alias(f"_f{j}") for j, c in enumerate(factors)]
        sums = [F.sum(c).alias(c) for c in ["n", *_names("s", len(self.means))]]
        table = self.table.groupBy(*keys or [F.lit("all").alias("_f0")]).agg(*sums)
        return replace(self, factors=list(factors), table=table)

    def projection(self, inner: np.ndarray, rank: int, cells: DataFrame, **more) -> Projection:
        """From the sums of products of the columns and their projections."""
        given = {"levels": None, "steps": 0, "converged": True} | more
        return Projection(self.factors, self.n, self.means, self.products, self.products - inner, rank, cells, **given)


def _names(kind: str, k: int) -> list[str]:
    return [f"_{kind}{j}" for j in range(k)]


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def project(
    df: DataFrame, factors: Sequence[str], columns: Sequence[str], tolerance: float = 1e-9, steps: int = 200
) -> Projection:
    """Project `columns` on the levels of `factors`, to a relative `tolerance` in at most `steps` steps."""
    return project_cells(sum_to_cells(df, factors, columns), tolerance, steps)


def sum_to_cells(df: DataFrame, factors: Sequence[str], columns: Sequence[str]) -> Cells:
    k, f = len(columns), len(factors)
    whole = all(isinstance(df.schema[c].dataType, IntegralType) for c in factors)
    rows = df.select(
        *[F.col(c).cast("bigint" if whole else "string").alias(f"_f{i}") for i, c in enumerate(factors)],
        *[F.col(c).cast("double").alias(f"_y{j}") for j, c in enumerate(columns)],
    ).dropna("any")
    ys = _names("y", k)
    head = rows.agg(
        F.count(F.lit(1)), *[F.avg(y) for y in ys], *[F.covar_pop(ys[i], ys[j]) for i, j in _pairs(k)]
    ).first()
    n, means = int(head[0]), np.array([v or 0.0 for v in head[1 : k + 1]])
    if not n:
        raise ValueError("no complete rows")
    table = rows.groupBy(*_names("f", f)).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(y) - F.lit(float(m))).alias(s) for y, m, s in zip(ys, means, _names("s", k), strict=True)],
    )
    return Cells(list(factors), n, means, _symmetric(head[k + 1 :], k) * n, stored(table))


def project_cells(cells: Cells, tolerance: float = 1e-9, steps: int = 200) -> Projection:
    k, f, c = len(cells.means), len(cells.factors), F.col
    if f < 2:
        found = cells.table.agg(*[F.sum(c(f"_s{i}") * c(f"_s{j}") / c("n")) for i, j in _pairs(k)], F.count(F.lit(1))).first()
        return cells.projection(_symmetric(found[:-1], k), int(found[-1]), _fitted(cells.table, None, 1, k))
    blocks, count = _blocks(cells.table, f, k)
    lists = F.arrays_zip("_factor", "_level", "_part", "_d", *_names("r", k))
    parts = stored(blocks.select("_block", F.posexplode(lists).alias("_at", "_x")).select("_block", "_at", "_x.*"))
    start = stored(
        parts.groupBy("_factor", "_level").agg(
            F.sum("_d").alias("_d"), F.collect_list(F.struct("_block", "_at")).alias("_to"), *[F.sum(r).alias(r) for r in _names("r", k)]
        )
    )
    closed = blocks.agg(F.sum("_closed"), *[F.sum(c("_inner")[at]) for at in range(len(_pairs(k)))]).first()
    means = _symmetric(closed[1:], k)  # what the levels of the first factor explain, the opened ones aside
    sizes = {r[0]: r[1] for r in start.groupBy("_factor").count().collect()}
    firsts = int(closed[0]) + sizes.pop(0, 0)
    levels, taken, converged = _gradients(blocks, start, count, f, k, tolerance, steps, NOTHING * np.diag(cells.products))
    inner = means + _symmetric(
        _dots(levels.join(start.drop("_d"), ["_factor", "_level"]), [c(f"_v{i}") * c(f"_r{j}") for i, j in _pairs(k)]), k
    )
    edges = parts.where("_factor < 2").select(c("_part").alias("_f0"), F.struct("_factor", "_level").alias("_f1"))
    # exact for two factors, a bound from above beyond
    rank = firsts + sum(sizes.values()) - _components(edges) - (f - 2)
    first = cells.of(cells.factors[:1])
    opened = _dots(start.where("_factor = 0"), [c(f"_r{i}") * c(f"_r{j}") / c("_d") for i, j in _pairs(k)])
    alone = first.projection(means + _symmetric(opened, k), firsts, _fitted(first.table, None, 1, k))
    levels = levels.where("_factor > 0")
    return cells.projection(
        inner, rank, _fitted(cells.table, levels, f, k), levels=levels, steps=taken, converged=converged, first=alone
    )


def _symmetric(values: Sequence[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = [v or 0.0 for v in values]
    return out + out.T - np.diag(np.diag(out))


def _blocks(cells: DataFrame, f: int, k: int) -> tuple[DataFrame, int]:
    """Cells by the first factor in blocks of a row each, and the number of blocks."""
    size = cells.count()
    partitions = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = max(1, min(partitions, size // BLOCK_CELLS), -(-size // MOST_CELLS))
    kind = cells.schema["_f0"].dataType.simpleString()
    ordered = cells.repartitionByRange(count, *_names("f", f)).sortWithinPartitions("_f0")
    schema = (
        "_block int, _starts binary, _codes binary, _n binary, _closed bigint, _inner array<double>, "
        f"_factor array<int>, _level array<{kind}>, _part array<bigint>, _d array<double>, "
        + ", ".join(f"_r{j} array<double>" for j in range(k))
    )
    return stored(ordered.mapInArrow(_pack(f, k, count == 1), schema)), count


def _pack(f: int, k: int, alone: bool):
    """A block from the cells of a task: where the levels of the first factor start, the place of
    each cell's other levels in the list of the block's levels, and rows per cell; besides, the parts of
    the right sides, and what the eliminated levels explain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = [b for b in batches if b.num_rows]
        if not filled:
            return
        table = pa.Table.from_batches(filled)
        coded = [pa.concat_arrays(table.column(name).chunks).dictionary_encode() for name in _names("f", f)]
        starts = np.flatnonzero(np.diff(coded[0].indices.to_numpy(), prepend=-1)).astype(np.int32)
        opened = [] if alone else sorted({0, len(starts) - 1})
        factor, level, codes = [0] * len(opened), [coded[0].dictionary.take(pa.array(opened, pa.int64()))], []
        for i, c in enumerate(coded[1:], 1):
            codes.append(c.indices.to_numpy() + np.int32(len(factor)))
            factor += [i] * len(c.dictionary)
            level.append(c.dictionary)
        codes, n = np.array(codes, np.int32), table.column("n").to_numpy()
        sums = np.array([table.column(s).to_numpy() for s in _names("s", k)]).reshape(k, len(n))
        right, inner, closed = _reduced(starts, codes, n, sums, len(opened), len(factor))
        weight = np.bincount(codes.reshape(-1), np.tile(n, f - 1), len(factor))
        weight[: len(opened)] = np.add.reduceat(n, starts)[opened]
        number = TaskContext.get().partitionId()
        graph = [(number << 32) + at if at >= 0 else None for at in _parts(starts, codes[0], opened, len(factor)).tolist()]
        n = n.astype(np.min_scalar_type(n.max()))
        row = {
            "_block": pa.array([number], pa.int32()),
            **{name: pa.array([x], pa.binary()) for name, x in [("_starts", starts.tobytes()), ("_codes", codes.tobytes()), ("_n", n.tobytes())]},
            "_closed": pa.array([closed], pa.int64()),
            "_inner": pa.array([inner], pa.list_(pa.float64())),
            "_factor": pa.array([factor], pa.list_(pa.int32())),
            "_level": pa.ListArray.from_arrays([0, len(factor)], pa.concat_arrays(level)),
            "_part": pa.array([graph], pa.list_(pa.int64())),
            "_d": pa.ListArray.from_arrays([0, len(factor)], pa.array(weight, pa.float64())),
            **{f"_r{j}": pa.ListArray.from_arrays([0, len(factor)], pa.array(right[j])) for j in range(k)},
        }
        yield pa.RecordBatch.from_pydict(row)

    return run


def _reduced(starts: np.ndarray, codes: np.ndarray, n: np.ndarray, w: np.ndarray, opened: int, size: int) -> tuple[np.ndarray, list[float], int]:
    """Cell sums around the means of their levels of the first factor, summed per level of the block;
    sums of squares and products of what the means take away, and the number of means. Levels of the
    first factor that are `opened`, its first and last, have no means."""
    k, ends = len(w), np.append(starts[1:], len(n))
    sums, counts = np.add.reduceat(w, starts, axis=1), np.add.reduceat(n, starts)
    means = sums / counts
    ways = [0, len(starts) - 1][:opened]
    means[:, ways] = 0.0
    inner = [float(means[i] @ sums[j]) for i, j in _pairs(k)]
    out = np.zeros((k, size))
    for j in range(k):
        left = w[j] - np.repeat(means[j], ends - starts) * n
        for code in codes:
            out[j] += np.bincount(code, left, size)
    out[:, : len(ways)] = sums[:, ways]
    return out, inner, len(starts) - len(ways)


def _parts(starts: np.ndarray, code: np.ndarray, opened: list[int], size: int) -> np.ndarray:
    """Connected part of each level of the second factor and each opened one of the first, within the
    block; -1 for levels of further factors."""
    label = np.full(size, size)
    label[code] = code
    lengths = np.diff(starts, append=len(code))
    while True:
        least = np.minimum.reduceat(label[code], starts)
        now = label.copy()
        np.minimum.at(now, code, np.repeat(least, lengths))
        known = now < size
        now[known] = now[now[known]]
        if (now == label).all():
            label[: len(opened)] = least[opened]
            return np.where(label < size, label, -1)
        label = now


def _turned(f: int, k: int):
    """A block's part of the product of the reduced matrix and the directions of its levels."""

    def run(block: pa.Table, levels: pa.Table) -> pa.Table:
        order = np.argsort(levels.column("_at").to_numpy())
        p = np.array([levels.column(name).to_numpy()[order] for name in _names("p", k)])
        starts = np.frombuffer(block.column("_starts")[0].as_py(), np.int32)
        codes = np.frombuffer(block.column("_codes")[0].as_py(), np.int32).reshape(f - 1, -1)
        packed = block.column("_n")[0].as_py()
        n = np.frombuffer(packed, f"u{len(packed) // codes.shape[1]}").astype(np.float64)
        opened = int((levels.column("_factor").to_numpy() == 0).sum())
        w = sum(p[:, code] for code in codes)
        ends = np.append(starts[1:], len(n))
        for at, level in enumerate([0, len(starts) - 1][:opened]):
            w[:, starts[level] : ends[level]] += p[:, at : at + 1]
        w *= n
        q = _reduced(starts, codes, n, w, opened, p.shape[1])[0]
        keys = levels.select(["_factor", "_level"]).take(pa.array(order))
        return pa.table({"_factor": keys.column(0), "_level": keys.column(1), **{f"_q{j}": q[j] for j in range(k)}})

    return run


def _with_levels(cells: DataFrame, levels: DataFrame, f: int, k: int, kind: str, out: str) -> DataFrame:
    """Cells with the sum over their levels of the columns `kind` as columns `out`."""
    rows = cells
    for i in range(1, f):
        part = levels.where(F.col("_factor") == i).select(
            F.col("_level").alias(f"_f{i}"), *[F.col(f"_{kind}{j}").alias(f"_g{i}_{j}") for j in range(k)]
        )
        rows = rows.join(part, f"_f{i}")
    added = [reduce(Column.__add__, [F.col(f"_g{i}_{j}") for i in range(1, f)]).alias(f"_{out}{j}") for j in range(k)]
    return rows.select(*cells.columns, *added)


def _gradients(
    blocks: DataFrame, start: DataFrame, count: int, f: int, k: int, tolerance: float, steps: int, nothing: np.ndarray
) -> tuple[DataFrame, int, bool]:
    """Coefficients of all levels that are not eliminated, steps taken, and whether they sufficed.

    The matrix is singular where factors overlap, but the right sides lie in its range. Right
    sides not above `nothing`, of columns that the first factor determines, are rounding.
    """
    c = F.col
    state = stored(
        start.withColumns({f"_v{j}": F.lit(0.0) for j in range(k)} | {f"_p{j}": c(f"_r{j}") / c("_d") for j in range(k)})
    )
    # kept by block, so that only directions move in a step
    kept = blocks.select("_block", "_starts", "_codes", "_n").repartition(count, "_block").persist()
    kind = start.schema["_level"].dataType.simpleString()
    schema = f"_factor int, _level {kind}, " + ", ".join(f"_q{j} double" for j in range(k))
    first, taken, done = None, 0, np.zeros(k, bool)
    while taken < steps and not done.all():
        sent = state.select("_factor", "_level", *_names("p", k), F.inline("_to")).repartition(count, "_block")
        turned = kept.groupBy("_block").cogroup(sent.groupBy("_block")).applyInArrow(_turned(f, k), schema)
        turned = turned.groupBy("_factor", "_level").agg(*[F.sum(q).alias(q) for q in _names("q", k)])
        both = stored(state.join(turned, ["_factor", "_level"]))
        size, along, against, mixed, turned_size = _dots(
            both, [e for j in range(k) for e in _products(c(f"_p{j}"), c(f"_q{j}"), c(f"_r{j}"), c("_d"))]
        ).reshape(k, 5).T
        first = size if first is None else first
        done = size <= np.maximum(tolerance**2 * first, nothing)
        go = np.where((along > 0) & ~done, against / np.where(along > 0, along, 1.0), 0.0)
        # the new size only bends the next direction; it is taken anew from the residuals in the next step
        after = np.maximum(size - 2 * go * mixed + go**2 * turned_size, 0.0)
        keep = np.where(done, 0.0, after / np.where(size > 0, size, 1.0))
        moved = both.withColumns(
            {f"_v{j}": c(f"_v{j}") + F.lit(float(go[j])) * c(f"_p{j}") for j in range(k)}
            | {f"_r{j}": c(f"_r{j}") - F.lit(float(go[j])) * c(f"_q{j}") for j in range(k)}
        )
        state = moved.withColumns({f"_p{j}": c(f"_r{j}") / c("_d") + F.lit(float(keep[j])) * c(f"_p{j}") for j in range(k)})
        state = state.drop(*_names("q", k))
        taken += not done.all()
    kept.unpersist()
    return stored(state.select("_factor", "_level", "_d", *_names("v", k))), taken, bool(done.all())


def _products(p: Column, q: Column, r: Column, d: Column) -> tuple[Column, ...]:
    """Size of the residual, and what moves along the direction p change of it."""
    return r * r / d, p * q, p * r, r * q / d, q * q / d


def _dots(table: DataFrame, terms: Sequence[Column]) -> np.ndarray:
    return np.array([v or 0.0 for v in table.agg(*[F.sum(t) for t in terms]).first()])


def _fitted(cells: DataFrame, levels: DataFrame | None, f: int, k: int) -> DataFrame:
    """Cells with the projections _t0, ... of the columns on all levels."""
    if levels is None:
        rows = cells.withColumns({t: F.lit(0.0) for t in _names("t", k)})
    else:
        rows = _with_levels(cells, levels, f, k, "v", "t")
    first = rows.groupBy("_f0").agg(
        *[((F.sum(f"_s{j}") - F.sum(F.col("n") * F.col(f"_t{j}"))) / F.sum("n")).alias(f"_m{j}") for j in range(k)]
    )
    both = rows.join(first, "_f0")
    return both.select(*cells.columns, *[(F.col(f"_t{j}") + F.col(f"_m{j}")).alias(f"_t{j}") for j in range(k)])


def _components(edges: DataFrame) -> int:
    """Connected parts of the graph of edges _f0, _f1, by spreading least labels."""
    labels = stored(edges.groupBy("_f1").agg(F.min("_f1").alias("_label")))
    while True:
        left = edges.join(labels, "_f1").groupBy("_f0").agg(F.min("_label").alias("_least"))
        spread = edges.join(left, "_f0").groupBy("_f1").agg(F.min("_least").alias("_least"))
        now = stored(labels.join(spread, "_f1").withColumn("_moved", F.col("_least") < F.col("_label")))
        labels = now.select("_f1", F.least("_label", "_least").alias("_label"))
        if not now.where("_moved").take(1):
            return labels.select("_label").distinct().count()


@dataclass
class AbsorbedFit:
    """A fitted model; `beta` has an estimate, or nan, per covariate."""

    names: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    n: int
    rank: int
    sse: float
    total: float
    projection: Projection

    @property
    def df_resid(self) -> int:
        return self.n - self.rank

    @property
    def mse(self) -> float:
        return self.sse / self.df_resid if self.df_resid > 0 else float("nan")


def fit_absorbed(
    df: DataFrame, y: str, factors: Sequence[str], covariates: Sequence[str] = (), tolerance: float = 1e-9, steps: int = 200
) -> AbsorbedFit:
    """Least squares of y on covariates and all levels of the factors."""
    return _fit(project(df, factors, [y, *covariates], tolerance, steps), covariates)


def _fit(found: Projection, covariates: Sequence[str]) -> AbsorbedFit:
    r, k = found.residual, len(covariates)
    free = [j for j in range(1, k + 1) if r[j, j] > 1e-9 * max(found.products[j, j], 1e-300)]
    beta, cov, sse, rank = np.full(k, np.nan), np.full((k, k), np.nan), float(r[0, 0]), 0
    if free:
        scale = np.sqrt(np.diag(r)[free])
        inverse = np.linalg.pinv(r[np.ix_(free, free)] / np.outer(scale, scale), rcond=1e-9, hermitian=True)
        rank = int(np.linalg.matrix_rank(r[np.ix_(free, free)] / np.outer(scale, scale), tol=1e-9 * len(free), hermitian=True))
        inverse = inverse / np.outer(scale, scale)
        at = np.array(free) - 1
        beta[at] = inverse @ r[free, 0]
        sse -= float(beta[at] @ r[free, 0])
        left = found.n - found.rank - rank
        cov[np.ix_(at, at)] = inverse * (sse / left if left > 0 else np.nan)
    return AbsorbedFit(list(covariates), beta, cov, found.n, found.rank + rank, max(sse, 0.0), float(found.products[0, 0]), found)


def tidy_absorbed(spark, fit: AbsorbedFit) -> DataFrame:
    """(term, estimate, std_error, statistic, p_value); null where the factors determine a covariate."""
    rows = []
    for j, name in enumerate(fit.names):
        b, s = fit.beta[j], np.sqrt(fit.covariance[j, j])
        known = np.isfinite(b)
        t = float(b / s) if known and s > 0 else None
        rows.append((name, float(b) if known else None, float(s) if known else None, t, None if t is None else t_tail(t, fit.df_resid)))
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, statistic double, p_value double")


def level_effects(fit: AbsorbedFit) -> DataFrame:
    """(factor, level, n, effect): the estimated effect of every level of every factor.

    Effects of a factor are around their mean over the rows. Only differences within one
    connected part of the first two factors are determined by the data.
    """
    p = fit.projection
    weights = [1.0, *[-float(b) if np.isfinite(b) else 0.0 for b in fit.beta]]
    f = len(p.factors)

    def blend(kind: str) -> Column:
        return reduce(Column.__add__, [F.col(f"_{kind}{j}") * F.lit(w) for j, w in enumerate(weights)])

    first = p.cells.select("_f0", "n", *_names("f", f)[1:], blend("t").alias("_e"))
    tables = []
    if p.levels is not None:
        others = p.levels.select("_factor", "_level", F.col("_d").alias("n"), blend("v").alias("effect"))
        for i in range(1, f):
            part = others.where(F.col("_factor") == i)
            tables.append(part.select(F.lit(p.factors[i]).alias("factor"), F.col("_level").cast("string").alias("level"), "n", "effect"))
            first = first.join(part.select(F.col("_level").alias(f"_f{i}"), F.col("effect").alias(f"_g{i}")), f"_f{i}")
            first = first.withColumn("_e", F.col("_e") - F.col(f"_g{i}")).drop(f"_g{i}")
    own = stored(first.groupBy("_f0").agg(F.sum("n").alias("n"), F.avg("_e").alias("effect")))
    tables.insert(0, own.select(F.lit(p.factors[0]).alias("factor"), F.col("_f0").cast("string").alias("level"), "n", "effect"))
    out = []
    for t in tables:
        middle = t.agg(F.sum(F.col("n") * F.col("effect")) / F.sum("n")).scalar()
        out.append(t.withColumn("effect", F.col("effect") - middle))
    return reduce(DataFrame.unionByName, out)


def anova_absorbed(
    df: DataFrame, y: str, factors: Sequence[str], covariates: Sequence[str] = (), kind: str = "sequential", **limits
) -> DataFrame:
    """Analysis of variance of the factors, after the covariates.

    "sequential" tests each factor after those before it, "marginal" after all others. Columns as
    in the tables of factorial models, so that effect sizes are taken from it in the same way.
    """
    if kind not in ("sequential", "marginal"):
        raise ValueError("kind is sequential or marginal")
    factors = list(factors)
    cells = sum_to_cells(df, factors, [y, *covariates])
    full = _fit(project_cells(cells, **limits), covariates)

    def fitted(some: Sequence[str]) -> AbsorbedFit:
        # the first factor alone is a by-product of the full model
        alone = full.projection.first if list(some) == factors[:1] else None
        return _fit(alone or project_cells(cells.of(some), **limits), covariates)

    ends = [factors[:i] for i in range(len(factors))] if kind == "sequential" else [[g for g in factors if g != h] for h in factors]
    smaller = [fitted(s) for s in ends]
    larger = [*smaller[1:], full] if kind == "sequential" else [full] * len(factors)
    table = []
    for name, a, b in zip(factors, smaller, larger, strict=True):
        ss, d = a.sse - b.sse, b.rank - a.rank
        f = ss / d / full.mse if d > 0 and full.mse > 0 else None
        table.append((name, d, ss, f, None if f is None else f_tail(f, d, full.df_resid), full.mse, full.total))
    table.append(("Residuals", full.df_resid, full.sse, None, None, full.mse, full.total))
    return df.sparkSession.createDataFrame(table, ANOVA_SCHEMA)
