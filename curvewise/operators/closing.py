"""Curve families together with their limit curves, searched to the end.

Many optima lie at infinity: of theta-logistic curves at theta = 0, where they are
x (a + b ln x), of Briere curves at t0 = -inf, or with tm and 1/m growing together, where they are
x exp(-c x). Rounds on the parameters never arrive there, and on the way the digits of the curve
are lost. Here a family has coordinates from 0 to 1 in which its limits are ordinary points, and
its linear parameters are solved for. The residual sum as a function of at most three
coordinates is lowered by Newton steps on a stencil, whose mesh shrinks whenever a round gains
nothing; so a search ends by itself, and there is no number of rounds after which it is given up.
It ends in the valley in which it began.

The functions work on arrays, coordinates first and groups last. Curves are written once for
arrays and for Spark columns, so groups of any size are searched alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvewise.operators.joining import attach
from curvewise.session import stored

#: Number of coordinates of each family.
SIZE = {"lactin1": 2, "lactin2": 2, "theta_logistic": 1, "briere1": 2, "briere2": 3}
#: Coordinates, and numbers of a curve, of any family at most.
WIDTH = 3
#: First, coarsest and finest mesh of the stencil; coordinates nearer than EDGE to 0 or 1 count as the limit.
MESH, COARSEST, FINEST, EDGE = 1e-2, 0.1, 1e-6, 1e-9
#: Damping of the trials, as shares of the largest curvature.
DAMPING = (0.0, 1e-6, 1e-4, 1e-2, 1.0)
#: Sums over the rows of a group: products of the curve's columns and what it leaves of y.
MOMENTS = ("_00", "_01", "_11", "_0y", "_1y", "_yy")
#: What is known of a group: largest |x|, least x that is not 0, largest x, size of y, and sum of its squares.
FACTS = ("_reach", "_low", "_high", "_unit", "_size")


class Arrays:
    """What a curve needs of numpy."""

    exp, expm1, log1p, log, larger, where = np.exp, np.expm1, np.log1p, np.log, np.maximum, np.where


class Columns:
    """What a curve needs of Spark."""

    exp, expm1, log1p, log = F.exp, F.expm1, F.log1p, F.log

    @staticmethod
    def larger(a: Column, b: float) -> Column:
        return F.greatest(a, F.lit(b))

    @staticmethod
    def where(test: Column, a: Column, b: Column) -> Column:
        return F.when(test, a).otherwise(b)


def _ratio(z: np.ndarray) -> np.ndarray:
    """A coordinate from 0 to 1 as a number from 0 to infinity, both ends cut off at rounding."""
    return np.maximum(z, EDGE) / np.maximum(1 - z, EDGE)


def _spread(mid: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Scale of the second Lactin coordinate: a rise of size `unit` comes from exponents about exp(-mid) apart."""
    size = mid + np.log(np.maximum(mid, 1e-300) / unit)
    top = np.minimum(size, 300)
    return np.arcsinh(1 + np.exp(top)) + (size - top)


def _exponents(z: np.ndarray, group: Mapping) -> np.ndarray:
    """P, Q and Q - P of exp(P s) - C exp(Q s): z[0] is their mean, z[1] is 0 at P = 0, 1/2 at P = Q, 1 at Q = 0.

    Where both are large, the two terms cancel and only nearly equal ones make a curve of the
    size of the data: z[1] has a scale on which that is no narrow valley.
    """
    mid, way = _ratio(z[0]), 2 * z[1] - 1
    w = _spread(mid, group["_unit"])
    share = np.sign(way) * np.exp(w * (np.abs(way) - 1)) * np.expm1(-2 * w * np.abs(way)) / np.expm1(-2 * w)
    return np.array([mid * (1 + share), mid * (1 - share), -2 * mid * share])


def _middled(p: np.ndarray, q: np.ndarray, group: Mapping) -> np.ndarray:
    """The inverse of `_exponents`."""
    mid = (p + q) / 2
    share, w = (p - q) / np.maximum(p + q, 1e-300), _spread(mid, group["_unit"])
    small = np.arcsinh(share * np.sinh(np.minimum(w, 300)))
    way = np.where(w < 300, small, np.sign(share) * np.maximum(w + np.log(np.abs(share) + 1e-300), 0)) / w
    return np.clip(np.array([mid / (1 + mid), (1 + way) / 2]), 0, 1)


def _apart(z: np.ndarray, group: Mapping) -> np.ndarray:
    c = _exponents(z, group)[:2]
    return np.clip(c / (1 + c), 0, 1)


def _charts(model: str) -> list[tuple[Callable, Callable]]:
    """Ways to and from coordinates in which steps are made; a valley may be straight in one and bent in another."""
    same = (lambda z, group: z, lambda z, group: z)
    if model not in ("lactin1", "lactin2"):
        return [same]
    return [same, (_apart, lambda z, group: _middled(*_ratio(z), group))]


def coordinates(model: str, points: np.ndarray, group: Mapping) -> np.ndarray:
    """Coordinates of curves given by parameters."""
    reach = group["_reach"]
    if model in ("lactin1", "lactin2"):
        return _middled(points[0] * reach, np.minimum(reach / points[2], 1 / EDGE), group)
    if model == "theta_logistic":
        c = points[1:2]
    else:
        near = reach / (reach + points[1])
        c = np.array([reach / (reach - points[0]), near, near / (points[2] if model == "briere2" else 2)][: SIZE[model]])
    return np.clip(np.where(np.isposinf(c), 1.0, c / (1 + c)), 0, 1)


def numbers(model: str, z: np.ndarray, group: Mapping) -> np.ndarray:
    """What `columns` takes of the coordinates."""
    return _exponents(z, group) if model in ("lactin1", "lactin2") else _ratio(z)


def columns(model: str, o, x, group: Mapping, c: Sequence):
    """(v0, v1, fixed): the curve is fixed + b0 v0 + b1 v1; None means that there is none."""
    reach, low, high = group["_reach"], group["_low"], group["_high"]
    s = x / reach
    if model in ("lactin1", "lactin2"):  # exp(P s) - C exp(Q s), C above 0; with a constant, Q = 0 is a straight line
        p, q, apart = c
        fixed = o.where(_close(apart), o.exp(q * s) * o.expm1(-apart * s), o.exp(p * s))
        q, down = o.larger(q, EDGE), (x - high) / reach
        if model == "lactin1":
            return None, o.exp(q * down), fixed
        return 1.0 + 0.0 * x, o.expm1(q * down) / -o.expm1(-q * _wide(o, reach, low, high)), fixed
    if model == "theta_logistic":  # a x + b x (s^theta - 1) / theta, at theta = 0 a x + b x ln s
        logs = o.log(o.where(s == 0, 1.0 + 0.0 * s, s))
        return 1.0 * x, x * o.expm1(c[0] * logs) / c[0] * (1.0 + c[0]), None
    start = 1.0 - c[0] * (1.0 - s)  # (x - t0) / (reach - t0)
    left = 1.0 - c[1] * (1.0 + s)  # (tm - x) / (tm + reach)
    if model == "briere1":
        root = o.exp(o.log(o.where(left > 0, left, 1.0 + 0.0 * left)) / 2.0)
    else:  # left to the power 1/m = c2 / c1, for c1 = 0 exp(-c2 (1 + s)), over that at the lowest x
        used = o.where(left > 0, -c[1] * (1.0 + s), 0.0 * left)
        lowest = o.larger(1.0 - c[1] * (1.0 + low / reach), 1e-300)
        at_low = o.where(lowest > 0.5, o.log1p(o.larger(-c[1] * (1.0 + low / reach), -0.5)), o.log(lowest))
        root = o.exp(c[2] * (o.log1p(used) - at_low) / c[1])
    return None, o.where((start > 0) & (left > 0), x * start * root, 0.0 * left), None


def _close(apart):
    """Where exp(Q s) is taken out of exp(P s), which keeps the digits of their difference."""
    return (apart < 1.0) & (apart > -1.0)


def _wide(o, reach, low, high):
    return o.where(high > low, (high - low) / reach, 1.0 + 0.0 * high)


def _most(model: str, c: np.ndarray, group: Mapping) -> np.ndarray:
    """Largest coefficient of v1 of a Lactin curve, where C is 0."""
    _, q, apart = c
    q = np.maximum(q, EDGE)
    top = np.exp(q * group["_high"] / group["_reach"])
    if model == "lactin2":
        top = -top * np.expm1(-q * _wide(Arrays, group["_reach"], group["_low"], group["_high"]))
    return np.where(_close(apart), top, 0.0)


def _one(vy: np.ndarray, vv: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """Residual sum with one column."""
    return yy - np.where(vv > 0, vy * vy / vv, np.nan)


def residual_sum(model: str, z: np.ndarray, moments: Sequence[np.ndarray], group: Mapping) -> np.ndarray:
    """Least residual sum of a family at coordinates z from the MOMENTS there; nan where there is none."""
    a, b, c, ay, by, yy = moments
    det = a * c - b * b
    b0, b1 = (np.where(det > 1e-14 * a * c, v / det, np.nan) for v in (ay * c - by * b, by * a - ay * b))
    both = yy - b0 * ay - b1 * by
    if model in ("briere1", "briere2"):
        sse = _one(by, c, yy)
    elif model == "theta_logistic":  # r and r / k^theta are of one sign
        theta = numbers(model, z, group)[0]
        share = theta / (1 + theta)
        power = b1 / share
        alone = np.fmin(_one(ay, a, yy), _one(ay + share * by, a + 2 * share * b + share * share * c, yy))
        sse = np.where((b0 - power) * power <= 0, both, alone)
    else:
        most = _most(model, numbers(model, z, group), group)
        without = yy - 2 * most * by + most * most * c
        if model == "lactin1":
            sse = np.where(by < most * c, _one(by, c, yy), without)
        else:
            sse = np.where(b1 < most, both, _one(ay - most * b, a, without))
    # of a curve far larger than the data the difference is rounding
    true = np.isfinite(sse) & ((yy <= 1e4 * group["_size"]) | (sse > 1e-10 * yy))
    return np.where(true, np.maximum(sse, 0.0), np.nan)


def stencils(model: str, z: np.ndarray, mesh: np.ndarray, group: Mapping) -> np.ndarray:
    """Points (coordinates x points x groups) around z, in each chart."""
    return np.concatenate([back(_stencil(to(z, group), mesh), group) for to, back in _charts(model)], axis=1)


def steps(model: str, z: np.ndarray, mesh: np.ndarray, group: Mapping, found: np.ndarray) -> np.ndarray:
    """Newton steps, each damped more than the one before, from the sums `found` at the stencils."""
    charts = _charts(model)
    parts = np.split(found, len(charts))
    return np.concatenate(
        [back(_newton(_stencil(to(z, group), mesh), part, mesh), group) for (to, back), part in zip(charts, parts, strict=True)], axis=1
    )


def _stencil(z: np.ndarray, mesh: np.ndarray) -> np.ndarray:
    """The middle, inside the bounds, both sides and corners."""
    middle, p = np.clip(z, mesh, 1 - mesh), len(z)
    out = [middle]
    for i in range(p):
        out += [np.where(np.arange(p)[:, None] == i, middle + way * mesh, middle) for way in (1, -1)]
    for i in range(p):
        out += [np.where(np.isin(np.arange(p), (i, j))[:, None], middle + mesh, middle) for j in range(i + 1, p)]
    return np.array(out).transpose(1, 0, 2)


def _newton(around: np.ndarray, found: np.ndarray, mesh: np.ndarray) -> np.ndarray:
    p, middle = len(around), around[:, 0]
    f = np.where(np.isnan(found), np.nanmax(found, axis=0, initial=0.0), found)
    slope, bend = np.zeros((f.shape[1], p)), np.zeros((f.shape[1], p, p))
    for i in range(p):
        up, down = f[1 + 2 * i], f[2 + 2 * i]
        slope[:, i], bend[:, i, i] = (up - down) / 2, up + down - 2 * f[0]
    k = 1 + 2 * p
    for i in range(p):
        for j in range(i + 1, p):
            bend[:, i, j] = bend[:, j, i] = f[k] - f[1 + 2 * i] - f[1 + 2 * j] + f[0]
            k += 1
    points = []
    for damp in DAMPING:
        to = middle + mesh * _downhill(slope, bend, damp).T
        held = (to < 0) | (to > 1)  # of a step out of bounds the coordinate stays at the bound, the others are solved again
        bound = np.where(held, (np.clip(to, 0, 1) - middle) / mesh, 0.0)
        rest = np.where(held.T, 0.0, slope + np.einsum("gij,gj->gi", bend, bound.T))
        free = ~held.T[:, :, None] & ~held.T[:, None, :]
        again = _downhill(rest, np.where(free, bend, 0.0), damp)
        points.append(np.clip(middle + mesh * np.where(held, bound, again.T), 0, 1))
    return np.array(points).transpose(1, 0, 2)


def _downhill(slope: np.ndarray, bend: np.ndarray, damp: float) -> np.ndarray:
    """Step of a quadratic, whose curvature counts by its size."""
    value, way = np.linalg.eigh(bend)
    value = np.abs(value)
    value = value + np.maximum((damp + 1e-12) * value.max(axis=1, keepdims=True), 1e-300)
    return -np.einsum("gij,gj->gi", way, np.einsum("gji,gj->gi", way, slope) / value)


def chosen(z, mesh, sse, tried, found, near, size, tolerance, nothing):
    """(z, mesh, sse, settled) after a round: the least sum of all points tried, the first `near` of them on stencils.

    A search has settled when a round on the finest mesh gains no more than `tolerance` of the sum.
    """
    at, every = np.argmin(np.where(np.isnan(found), np.inf, found), axis=0), np.arange(len(mesh))
    best = found[at, every]
    ok = best < sse
    gained = ok & (sse - best > tolerance * sse)
    moved = np.abs(tried[:, at, every] - z).max(axis=0)
    z, low = np.where(ok, tried[:, at, every], z), np.where(ok, best, sse)
    settled = (~gained & (mesh <= FINEST)) | (low <= nothing * size)
    wider = np.where(at < near, mesh * 4, np.clip(moved / 2, mesh / 4, mesh * 4))
    return z, np.clip(np.where(gained, wider, mesh / 4), FINEST, COARSEST), low, settled


def lower(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which start has the least sum, and that sum; nan where none has one."""
    at = np.argmin(np.where(np.isnan(found), np.inf, found), axis=0)
    return at, found[at, np.arange(found.shape[1])]


def search(
    model: str, evaluate: Callable[[np.ndarray, np.ndarray], np.ndarray], starts: np.ndarray, group: Mapping,
    tolerance: float, nothing: float,
) -> np.ndarray:
    """Residual sums that groups reach from the best of their starts (coordinates x starts x groups).

    `evaluate(points, which)` gives the sums of some groups.
    """
    every = np.arange(starts.shape[2])
    at, sse = lower(evaluate(starts, every))
    z, mesh, left = starts[:, at, every], np.full(len(every), MESH), np.flatnonzero(~np.isnan(sse))
    while len(left):
        some = {k: v[left] for k, v in group.items()}
        around = stencils(model, z[:, left], mesh[left], some)
        near = evaluate(around, left)
        far = steps(model, z[:, left], mesh[left], some, near)
        tried, found = np.concatenate([around, far], axis=1), np.concatenate([near, evaluate(far, left)])
        z[:, left], mesh[left], sse[left], settled = chosen(
            z[:, left], mesh[left], sse[left], tried, found, len(near), some["_size"], tolerance, nothing
        )
        left = left[~settled]
    return sse


# --- groups of any size, by aggregations -------------------------------------


def facts(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FACTS of every group that has an x other than 0."""
    x, squares = F.col("x"), F.sum(F.col("ss") + F.col("n") * F.col("mean") * F.col("mean"))
    found = sums.groupBy(*keys).agg(
        F.max(F.abs(x)).alias("_reach"), F.min(F.when(x != 0, x)).alias("_low"), F.max(x).alias("_high"),
        F.when(squares > 0, F.sqrt(squares / F.sum("n"))).otherwise(F.lit(1.0)).alias("_unit"), squares.alias("_size"),
    )
    return found.where("_reach > 0")


def search_wide(sums: DataFrame, starts: DataFrame, keys: Sequence[str], tolerance: float, nothing: float) -> DataFrame:
    """(keys, _model, _sse): as `search`, each evaluation one aggregation over the per-x table.

    `starts` has keys, _model, and the parameters of two starts as _l0, ... and _r0, ...; its
    groups whose curves have no sum at either start are left out.
    """
    by = [*keys, "_model"]
    models = [row._model for row in starts.select("_model").distinct().collect()]
    of_groups = stored(facts(sums, keys))
    known, begun = stored(attach(sums, of_groups, keys, "inner")), attach(starts, of_groups, keys, "inner")
    fields = ", ".join(f"`{k}` {dict(starts.dtypes)[k]}" for k in by)
    points = f"{fields}, _i int, _c0 double, _c1 double, _c2 double"
    state = ", ".join([fields, *[f"{c} double" for c in ("_z0", "_z1", "_z2", "_mesh", "_sse", *FACTS)], "_settled boolean"])
    made, products = _expressions(models)

    def asked(df: DataFrame, ask: Callable, into: str) -> DataFrame:
        """Moments of all points that `ask` makes of the states, packed next to each state."""
        tried = df.mapInArrow(lambda batches: _points(batches, by, ask), points)
        found = attach(known, tried, keys, "inner").withColumns(made).groupBy(*by, "_i").agg(*products)
        return attach(df, found.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", *MOMENTS))).alias(into)), by)

    def told(df: DataFrame, tell: Callable) -> DataFrame:
        return stored(df.mapInArrow(lambda batches: _states(batches, by, tell), state))

    now = told(asked(stored(begun), _begin_points, "_at"), _begin)
    ended = [now.where("_settled")]
    while not (left := now.where("NOT _settled")).isEmpty():
        near = stored(asked(left, _near_points, "_near"))
        now = told(asked(near, _far_points, "_far"), lambda model, s: _end_round(model, s, tolerance, nothing))
        ended.append(now.where("_settled"))
    return reduce(DataFrame.unionByName, ended).where("NOT isnan(_sse)").select(*by, "_sse")


def _expressions(models: Sequence[str]) -> tuple[dict[str, Column], list[Column]]:
    """The curve's columns next to rows that have _model, FACTS and the numbers of a curve, and the MOMENTS made of them."""
    group, c = {k: F.col(k) for k in FACTS}, [F.col(f"_c{i}") for i in range(WIDTH)]
    parts = {m: columns(m, Columns, F.col("x"), group, c) for m in models}

    def of(k: int) -> Column:
        """A column of the model of each row, 0 where it has none."""
        return F.coalesce(*[F.when(F.col("_model") == m, F.lit(0.0) if v[k] is None else v[k]) for m, v in parts.items()])

    n, a, b, y = (F.col(v) for v in ("n", "_v0", "_v1", "_y"))
    products = [n * a * a, n * a * b, n * b * b, n * a * y, n * b * y, F.col("ss") + n * y * y]
    made = {"_v0": of(0), "_v1": of(1), "_y": F.col("mean") - of(2)}
    return made, [F.sum(v).alias(k) for v, k in zip(products, MOMENTS, strict=True)]


def _by_model(batch: pa.RecordBatch, by: Sequence[str]) -> Iterator[tuple[str, np.ndarray, dict]]:
    """Model, rows and columns as arrays of the states of each model; packed moments as (moments x points x groups)."""
    of = np.array(batch.column(batch.schema.get_field_index("_model")).to_pylist())
    for model in dict.fromkeys(of):
        rows, s = np.flatnonzero(of == model), {}
        some = batch.take(pa.array(rows))
        for name in batch.schema.names:
            column = some.column(some.schema.get_field_index(name))
            if name not in by and pa.types.is_floating(column.type):
                s[name] = column.to_numpy(zero_copy_only=False)
            elif name in ("_at", "_near", "_far"):
                flat = column.flatten()
                s[name] = np.array([flat.field(k + 1).to_numpy(zero_copy_only=False).reshape(len(rows), -1).T for k in range(len(MOMENTS))])
        s["group"] = {k: s[k] for k in FACTS}
        if "_z0" in s:
            s["z"] = np.array([s[f"_z{i}"] for i in range(SIZE[model])])
        yield str(model), rows, s


def _points(batches: Iterator[pa.RecordBatch], by: Sequence[str], ask: Callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for model, rows, s in _by_model(batch, by):
            with np.errstate(all="ignore"):
                z = ask(model, s)
                c = numbers(model, z, s["group"])
            count, each = z.shape[1], np.repeat(rows, z.shape[1])
            own = batch.select(list(by)).take(pa.array(each))
            flat = [c[i].T.ravel() if i < len(c) else np.zeros(len(each)) for i in range(WIDTH)]
            made = [*own.columns, pa.array(np.tile(np.arange(count, dtype=np.int32), len(rows))), *map(pa.array, flat)]
            yield pa.RecordBatch.from_arrays(made, names=[*by, "_i", "_c0", "_c1", "_c2"])


def _states(batches: Iterator[pa.RecordBatch], by: Sequence[str], tell: Callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for model, rows, s in _by_model(batch, by):
            with np.errstate(all="ignore"):
                z, mesh, sse, settled = tell(model, s)
            own = batch.select(list(by)).take(pa.array(rows))
            padded = [z[i] if i < len(z) else np.zeros(len(rows)) for i in range(WIDTH)]
            doubles = [*padded, mesh, sse, *[s[k] for k in FACTS]]
            yield pa.RecordBatch.from_arrays(
                [*own.columns, *map(pa.array, doubles), pa.array(settled)], names=[*by, "_z0", "_z1", "_z2", "_mesh", "_sse", *FACTS, "_settled"]
            )


def _begin_points(model: str, s: Mapping) -> np.ndarray:
    two = [coordinates(model, np.array([s[f"_{k}{i}"] for i in range(WIDTH)]), s["group"]) for k in "lr"]
    return np.array(two).transpose(1, 0, 2)


def _begin(model: str, s: Mapping) -> tuple:
    z, every = _begin_points(model, s), np.arange(len(s["_size"]))
    at, sse = lower(residual_sum(model, z, s["_at"], s["group"]))
    return z[:, at, every], np.full(len(every), MESH), sse, np.isnan(sse)


def _near_points(model: str, s: Mapping) -> np.ndarray:
    return stencils(model, s["z"], s["_mesh"], s["group"])


def _near_sums(model: str, s: Mapping) -> np.ndarray:
    return residual_sum(model, _near_points(model, s), s["_near"], s["group"])


def _far_points(model: str, s: Mapping) -> np.ndarray:
    return steps(model, s["z"], s["_mesh"], s["group"], _near_sums(model, s))


def _end_round(model: str, s: Mapping, tolerance: float, nothing: float) -> tuple:
    near, far = _near_sums(model, s), _far_points(model, s)
    tried = np.concatenate([_near_points(model, s), far], axis=1)
    found = np.concatenate([near, residual_sum(model, far, s["_far"], s["group"])])
    return chosen(s["z"], s["_mesh"], s["_sse"], tried, found, len(near), s["_size"], tolerance, nothing)
