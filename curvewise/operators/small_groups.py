"""Nonlinear fits of groups with few different x, many groups at a time inside a task.

The same lattice, trials and ends as the rounds of `nonlinear`, on arrays over a slice of
groups: the per-x sums of a group are packed into one row, so a fit needs one shuffle
instead of some per round. Only the trial that is kept costs derivatives. With `closed`, every
fit is then searched to its end as in `closing`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa

from curvewise.operators import closing

#: Numbers of one intermediate array; groups are taken in slices of about that size.
SLICE = 200_000
HUGE = np.finfo(float).max


def _lactin(x, p, tmax, dt):
    return np.exp(p * x) - np.exp(p * tmax - (tmax - x) / dt)


def _theta_logistic(x, k, theta):
    return x * (1 - (x / k) ** theta)


def _briere(x, t0, tm, m=None):
    room = np.maximum(tm - x, 0.0)
    root = np.sqrt(room) if m is None else room ** (1 / m)
    return np.where((x > t0) & (x < tm), x * (x - t0) * root, 0.0)


CURVES: dict[str, Callable] = {
    "lactin1": _lactin,
    "lactin2": _lactin,
    "theta_logistic": _theta_logistic,
    "briere1": _briere,
    "briere2": _briere,
}


@dataclass(frozen=True)
class Task:
    """What a task needs to know of one model."""

    name: str
    kind: str
    logs: tuple[bool, ...]  # parameters that are moved on the log scale
    points: tuple[tuple[float, ...], ...]  # of the lattice, for each parameter


class _Groups:
    """Per-x sums of some groups one after the other; `starts` has the first row of each."""

    def __init__(self, x, n, mean, ss, lens):
        self.x, self.n, self.mean, self.ss, self.lens = x, n, mean, ss, lens
        self.starts = (np.cumsum(lens) - lens).astype(np.int64)
        self.total = self.sum(n)
        self.size = self.sum(ss + n * mean * mean)

    def sum(self, v: np.ndarray) -> np.ndarray:
        """Sums per group along the last axis."""
        if not len(self.starts):
            return np.zeros((*v.shape[:-1], 0))
        return np.add.reduceat(v, self.starts, axis=-1)

    def spread(self, v: np.ndarray) -> np.ndarray:
        """A value per group on each of its rows."""
        return np.repeat(v, self.lens, axis=-1)

    def pick(self, some: np.ndarray) -> _Groups:
        rows = np.repeat(some, self.lens)
        return _Groups(self.x[rows], self.n[rows], self.mean[rows], self.ss[rows], self.lens[some])


def _linear_part(kind: str, d: _Groups, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear parameter and residual sum of squares of curves g, nan where there is none."""
    gap = d.mean - g
    if kind == "offset":
        lin = d.sum(d.n * gap) / d.total
        rest = gap - d.spread(lin)  # squares around the constant: a far larger curve leaves no digits in their difference
        return lin, d.sum(d.ss + d.n * rest * rest)
    if kind == "scale":
        gg, yg = d.sum(d.n * g * g), d.sum(d.n * d.mean * g)
        lin = np.where(gg > 0, yg / gg, np.nan)
        return lin, d.size - lin * yg
    sse = d.sum(d.ss + d.n * gap * gap)
    return np.zeros_like(sse), sse


def _least(sse: np.ndarray) -> np.ndarray:
    """Index of the least sum along the first axis, the first of equal ones; nan is no sum."""
    return np.argmin(np.where(np.isnan(sse), np.inf, np.minimum(sse, HUGE)), axis=0)


def _lattice(task: Task, d: _Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best lattice point (parameters x groups), linear parameter and sum of squares."""
    points = np.array(list(product(*map(sorted, task.points)))).T
    g = CURVES[task.name](d.x, *points[:, :, None])
    lin, sse = _linear_part(task.kind, d, np.broadcast_to(g, (points.shape[1], len(d.x))))
    at, every = _least(sse), np.arange(len(d.lens))
    none = np.isnan(sse[at, every])
    return np.where(none, np.nan, points[:, at]), np.where(none, np.nan, lin[at, every]), sse[at, every]


def _solve(m: list[list[np.ndarray]], r: Sequence[np.ndarray], tolerance: float) -> list[np.ndarray]:
    """As `columns.solve_symmetric`; nan where the system is singular."""

    def det(a):
        if len(a) == 1:
            return a[0][0]
        if len(a) == 2:
            return a[0][0] * a[1][1] - a[0][1] * a[1][0]
        return (
            a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1])
            - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0])
            + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
        )

    p = len(r)
    scale = np.prod([m[i][i] for i in range(p)], axis=0)
    d = det(m)
    d = np.where(d > tolerance * scale, d, np.nan)
    return [det([[r[i] if j == k else m[i][j] for j in range(p)] for i in range(p)]) / d for k in range(p)]


class _Local:
    """Rounds of one model over a slice of groups. Points are arrays, parameters first."""

    def __init__(self, task: Task):
        self.task, self.p, self.curve = task, len(task.logs), CURVES[task.name]

    def at(self, x: np.ndarray, points: Sequence[np.ndarray]) -> np.ndarray:
        return self.curve(x, *[np.exp(np.clip(v, -300, 300)) if log else v for v, log in zip(points, self.task.logs, strict=True)])

    def scores(self, d: _Groups, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _linear_part(self.task.kind, d, self.at(d.x, d.spread(points)))

    def system(self, d: _Groups, points: np.ndarray, lin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gauss-Newton matrix, what second derivatives add to it, and right side."""
        p, kind, n, mean = self.p, self.task.kind, d.n, d.mean
        at = list(d.spread(points))
        h = [np.full(len(d.x), 1e-4) if log else np.maximum(np.abs(v), 1e-3) * 1e-4 for v, log in zip(at, self.task.logs, strict=True)]

        def moved(**by):
            return self.at(d.x, [v + by.get(f"_{i}", 0.0) for i, v in enumerate(at)])

        g = moved()
        ups = [moved(**{f"_{i}": h[i]}) for i in range(p)]
        downs = [moved(**{f"_{i}": -h[i]}) for i in range(p)]
        slope = [(u - w) / (2 * s) for u, w, s in zip(ups, downs, h, strict=True)]
        gap, gg = d.sum(n * (mean - g)), d.sum(n * g * g)
        some = np.where(gg > 0, gg, np.nan)
        first = [d.sum(n * s) for s in slope]
        own = [d.sum(n * s * g) for s in slope]
        with_y = [d.sum(n * s * mean) for s in slope]
        a, b, r = np.zeros((p, p, len(d.lens))), np.zeros((p, p, len(d.lens))), np.zeros((p, len(d.lens)))
        for i in range(p):
            r[i] = with_y[i] - own[i]
            if kind == "offset":  # the constant takes the mean out of every column
                r[i] = r[i] - first[i] * gap / d.total
            elif kind == "scale":  # the factor takes the curve itself out of every column
                r[i] = lin * (with_y[i] - own[i] * lin)
            for j in range(i, p):
                if i == j:
                    e = (ups[i] - 2 * g + downs[i]) / (h[i] * h[i])
                else:
                    corners = moved(**{f"_{i}": h[i], f"_{j}": h[j]}) + moved(**{f"_{i}": -h[i], f"_{j}": -h[j]})
                    e = (corners - (ups[i] + downs[i] + ups[j] + downs[j]) + 2 * g) / (2 * h[i] * h[j])
                q, bend = d.sum(n * slope[i] * slope[j]), -d.sum(n * (mean - g) * e)
                if kind == "offset":
                    q = q - first[i] * first[j] / d.total
                    bend = bend + lin * d.sum(n * e)
                elif kind == "scale":
                    bend = lin * (bend - (1 - lin) * d.sum(n * g * e))
                    slack = [with_y[k] - lin * own[k] for k in (i, j)]
                    along = [lin * own[k] for k in (i, j)]
                    bend = bend + (along[0] * slack[1] + slack[0] * along[1] - slack[0] * slack[1]) / some
                    q = lin * lin * (q - own[i] * own[j] / some)
                a[i, j] = a[j, i] = q
                b[i, j] = b[j, i] = bend
        return a, b, r

    def trials(self, s: dict, fan: Sequence[tuple[str, float, bool]]) -> tuple[np.ndarray, ...]:
        """Points (parameters x trials x groups), promised gains and lengths of a round's trials."""
        p, points, promises, lengths = self.p, [], [], []
        a, b, r = s["a"], s["b"], s["r"]
        weight = [np.where(a[i, i] <= 0, 1.0, a[i, i]) for i in range(p)]  # a parameter without influence stays
        for way, f, own in fan:
            damped = s["damp"] * f if own else np.full_like(s["damp"], f)
            if way == "again":
                move, promise = [f * z for z in s["z"]], np.full_like(damped, np.nan)
            else:
                bent = 1.0 if way == "newton" else 0.0
                gram = [[(weight[i] * (1 + damped) if i == j else a[i, j]) + bent * b[i, j] for j in range(p)] for i in range(p)]
                move = _solve(gram, r, 1e-14)
                promise = sum(move[i] * (r[i] + damped * weight[i] * move[i]) for i in range(p))
            length = np.zeros_like(damped)
            for i in range(p):
                length = np.fmax(length, np.abs(move[i]) / (np.abs(s["point"][i]) + 1e-6))
            points.append([s["point"][i] + np.where(np.isnan(move[i]), 0.0, move[i]) for i in range(p)])
            promises.append(promise)
            lengths.append(np.where(np.isnan(move[0]), np.nan, length))
        return np.array(points).transpose(1, 0, 2), np.array(promises), np.array(lengths)

    def fit(self, d: _Groups, steps: int, tolerance: float, nothing: float, fan, free: int) -> dict[str, np.ndarray]:
        point, lin, first = _lattice(self.task, d)
        out = {"start": point, "point": point, "lin": lin, "sse": first, "first": first, "converged": np.zeros(len(first), bool)}
        out["steps"] = np.zeros(len(first), np.int32)
        if not steps:
            return out
        logs = np.array(self.task.logs)
        point = np.where(logs[:, None], np.log(np.where(logs[:, None], point, 1.0)), point)
        lin, sse = self.scores(d, point)
        a, b, r = self.system(d, point, lin)
        usable = ~np.isnan(sse)
        exact = sse <= nothing * d.size
        out.update(point=point, lin=lin, sse=sse, converged=usable & exact)
        alive = np.flatnonzero(usable & ~exact)
        s = {"point": point, "z": np.zeros_like(point), "a": a, "b": b, "r": r, "sse": sse, "lin": lin}
        s = {k: v[..., alive] for k, v in s.items()} | {"damp": np.full(len(alive), 0.03)}
        d = d.pick(np.isin(np.arange(len(usable)), alive))
        for _ in range(steps):
            if not len(alive):
                break
            tried, promise, length = self.trials(s, fan)
            lins, sums = self.scores(d, tried)
            best, every = _least(sums), np.arange(len(alive))
            found = sums[best, every]
            ok = found < s["sse"]
            small = tolerance * s["sse"]
            unpromising = promise[free] <= small
            gained = ok & (s["sse"] - found <= small) & (unpromising | (np.abs(promise[best, every]) <= small))
            end = gained | (~ok & (unpromising | (length[free] <= tolerance))) | (ok & (found <= nothing * d.size))
            settled = end | (~ok & (s["damp"] > 1e10))
            relative = np.array([f if own else 0.3 for _, f, own in fan])[best]
            s["damp"] = np.where(ok, np.maximum(s["damp"] * relative * 0.3, 1e-9), s["damp"] * 100)
            new = tried[:, best, every]
            s["z"] = np.where(ok, new - s["point"], s["z"])
            s["point"], s["sse"] = np.where(ok, new, s["point"]), np.where(ok, found, s["sse"])
            s["lin"] = np.where(ok, lins[best, every], s["lin"])
            for k in ("point", "lin", "sse"):
                out[k][..., alive] = s[k]
            out["steps"][alive] += 1
            out["converged"][alive] = end
            goes, stays = ok & ~settled, ~settled
            if goes.any():
                a, b, r = self.system(d.pick(goes), s["point"][:, goes], s["lin"][goes])
                s["a"][..., goes], s["b"][..., goes], s["r"][..., goes] = a, b, r
            if not stays.all():
                s, d, alive = {k: v[..., stays] for k, v in s.items()}, d.pick(stays), alive[stays]
        out["point"] = np.where(logs[:, None], np.exp(np.clip(out["point"], -300, 300)), out["point"])
        return out


def _closed(model: str, d: _Groups, fit: dict, tolerance: float, nothing: float) -> dict[str, np.ndarray]:
    """A fit searched to its end from its lattice point or from where its rounds ended; its curve may have no parameters."""
    top = lambda v: np.maximum.reduceat(v, d.starts)
    group = {"_reach": top(np.abs(d.x)), "_low": -top(np.where(d.x == 0, -np.inf, -d.x)), "_high": top(d.x)}
    group |= {"_unit": np.where(d.size > 0, np.sqrt(d.size / d.total), 1.0), "_size": d.size}

    def sums(z: np.ndarray, which: np.ndarray) -> np.ndarray:
        e, some = d.pick(np.isin(np.arange(len(d.lens)), which)), {k: v[which] for k, v in group.items()}
        of_rows = {k: e.spread(v) for k, v in some.items()}
        v0, v1, fixed = closing.columns(model, closing.Arrays, e.x, of_rows, e.spread(closing.numbers(model, z, some)))
        a, b, y = (np.zeros(1) if v0 is None else v0), v1, e.mean - (0.0 if fixed is None else fixed)
        products = [e.n * a * a, e.n * a * b, e.n * b * b, e.n * a * y, e.n * b * y, e.ss + e.n * y * y]
        return closing.residual_sum(model, z, [e.sum(np.broadcast_to(v, (z.shape[1], len(e.x)))) for v in products], some)

    starts = np.array([closing.coordinates(model, fit[k], group) for k in ("start", "point")]).transpose(1, 0, 2)
    sse = closing.search(model, sums, starts, group, tolerance, nothing)
    found = ~np.isnan(sse)
    gone = {k: np.where(found, np.nan, fit[k]) for k in ("point", "lin")}
    return {**fit, **gone, "sse": np.where(found, sse, fit["sse"]), "converged": found | fit["converged"]}


def fits(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str], tasks: Sequence[Task], width: int, steps: int,
    tolerance: float, nothing: float, fan: Sequence[tuple[str, float, bool]], free: int, closed: bool = False,
) -> Iterator[pa.RecordBatch]:
    """Fits of every model to packed groups: keys, _model, _p0, ..., _lin, _n, _sse, _first, _converged, _steps."""
    locals_ = [_Local(t) for t in tasks]
    for batch in batches:
        if not batch.num_rows:
            continue
        packed = batch.column(batch.schema.get_field_index("_xs"))
        lens = np.diff(packed.offsets.to_numpy())
        rows = packed.flatten()
        x, n, mean, ss = (rows.field(i).to_numpy(zero_copy_only=False).astype(float) for i in range(4))
        ends = np.cumsum(lens)
        for task, local in zip(tasks, locals_, strict=True):
            fan_out = int(np.prod([len(v) for v in task.points]))
            step = max(1, SLICE // max(fan_out, len(fan)))
            parts = (ends - 1) // step  # groups that end in the same stretch of rows
            done = []
            for part in np.unique(parts):
                some = np.flatnonzero(parts == part)
                rows_of = slice(int(ends[some[0]] - lens[some[0]]), int(ends[some[-1]]))
                d = _Groups(x[rows_of], n[rows_of], mean[rows_of], ss[rows_of], lens[some])
                with np.errstate(all="ignore"):
                    fit = local.fit(d, steps, tolerance, nothing, fan, free)
                    done.append((_closed(task.name, d, fit, tolerance, nothing) if closed else fit, d.total))
            get = lambda k: np.concatenate([f[k] for f, _ in done], axis=-1)  # noqa: B023, E731
            number = lambda v: pa.array(v, pa.float64(), from_pandas=True)  # noqa: E731  nan is null
            point = get("point")
            nothing_here = pa.nulls(batch.num_rows, pa.float64())
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            columns.append(pa.array([task.name] * batch.num_rows, pa.string()))
            columns += [number(point[i]) if i < len(point) else nothing_here for i in range(width)]
            columns.append(number(get("lin")))
            columns.append(pa.array(np.concatenate([t for _, t in done]).astype(np.int64)))
            columns += [number(get("sse")), number(get("first"))]
            columns += [pa.array(get("converged")), pa.array(get("steps"), pa.int32())]
            names = [*keys, "_model", *[f"_p{i}" for i in range(width)], "_lin", "_n", "_sse", "_first", "_converged", "_steps"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
