"""Nonlinear response curves per group.

Rows are first combined to per-x sums (group, x, n, mean, spread), so repeated
measurements at the same x never move again. A deterministic lattice of start values
is scored by aggregation, and the best point is improved by damped Gauss-Newton
steps, each one again an aggregation over the per-x table, until its group has settled.
A group with many different x is never brought into one task; only its few running sums are.
Groups with at most LOCAL_X of them are packed and fitted inside tasks (`small_groups`).
Curve families are compared by their least residual sums, limit curves included (`closing`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvewise.functions.columns import briere, lactin, solve_symmetric, theta_logistic
from curvewise.operators import closing
from curvewise.operators.fitting import _explained, _slopes, _sse, aic, fractional_moments, scaled_moments
from curvewise.operators.joining import attach, sequence_points, spaced, spread_out
from curvewise.operators.small_groups import Task, fits
from curvewise.session import stored

#: Groups with at most so many different x are fitted inside tasks, the others by aggregations.
LOCAL_X = 256
#: Rounds of refinement after which groups that have not settled are given up, and said so.
MAX_STEPS = 40
#: Trials of a round: the way, and the damping as a number or as a multiple of a group's own; the
#: last two repeat the move before, so many times as long.
FAN = (
    ("newton", 0.0, False),
    ("gauss", 1e-8, False),
    ("gauss", 0.1, True),
    ("gauss", 1.0, True),
    ("gauss", 10.0, True),
    ("again", 1.0, False),
    ("again", 3.0, False),
)
#: The trial whose promised gain tells whether a group has settled.
FREE = 1
#: A residual sum below this share of the sum of squares is rounding.
NOTHING = 1e-14


@dataclass(frozen=True)
class CurveModel:
    """A curve with `shape` parameters and one linear parameter.

    The linear parameter is an added constant ("offset") or a factor ("scale") and
    has a closed form for given shape parameters.
    """

    shape: tuple[str, ...]
    linear: str
    kind: str
    lattice: Mapping[str, tuple[float, float, int]]
    positive: tuple[str, ...] = ()

    def basis(self, x: Column, p: Mapping[str, Column]) -> Column:
        raise NotImplementedError


class Lactin1(CurveModel):
    def basis(self, x, p):
        return lactin(x, p["p"], p["tmax"], p["dt"])


class Lactin2(Lactin1):
    pass


class ThetaLogistic(CurveModel):
    def basis(self, x, p):
        return theta_logistic(x, F.lit(1.0), p["k"], p["theta"])


class Briere1(CurveModel):
    def basis(self, x, p):
        return briere(x, F.lit(1.0), p["t0"], p["tm"])


class Briere2(CurveModel):
    def basis(self, x, p):
        return briere(x, F.lit(1.0), p["t0"], p["tm"], p["m"])


# Start ranges (low, high, number of points) of each shape parameter.
MODELS: dict[str, CurveModel] = {
    "lactin1": Lactin1(
        ("p", "tmax", "dt"), "none", "fixed",
        {"p": (0.02, 0.3, 15), "tmax": (24.0, 40.0, 9), "dt": (1.0, 10.0, 10)}, ("p", "dt"),
    ),
    "lactin2": Lactin2(
        ("p", "tmax", "dt"), "lam", "offset",
        {"p": (0.02, 0.3, 15), "tmax": (24.0, 40.0, 9), "dt": (1.0, 10.0, 10)}, ("p", "dt"),
    ),
    "theta_logistic": ThetaLogistic(
        ("k", "theta"), "r", "scale", {"k": (20.0, 35.0, 16), "theta": (0.5, 5.0, 10)}, ("k", "theta")
    ),
    "briere1": Briere1(("t0", "tm"), "a", "scale", {"t0": (-5.0, 12.0, 18), "tm": (28.5, 45.0, 12)}),
    "briere2": Briere2(
        ("t0", "tm", "m"), "a", "scale",
        {"t0": (-5.0, 12.0, 18), "tm": (28.5, 45.0, 12), "m": (1.0, 6.0, 6)}, ("m",),
    ),
}


def per_x_sums(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, x, n, mean, ss): count, mean and within sum of squares at each x."""
    rows = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("_y"))
    sums = rows.dropna("any", subset=["x", "_y"]).groupBy(*keys, "x")
    return sums.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_y").alias("mean"),
        (F.count(F.lit(1)) * F.var_pop("_y")).alias("ss"),
    )


def _linear_part(model: CurveModel, basis: Column) -> dict[str, Column]:
    """Aggregates that give the linear parameter and the residual sum of squares."""
    n, mean = F.col("n"), F.col("mean")
    gap = mean - basis
    if model.kind == "offset":
        const = F.sum(n * gap) / F.sum(n)
        whole, size = F.sum(F.col("ss") + n * gap * gap), F.sum(F.col("ss") + n * mean * mean)
        sse = whole - F.sum(n) * const * const
        # of a curve far larger than the data the difference is rounding, and may be below 0
        return {"_lin": const, "_sse": F.when((whole <= 1e4 * size) | (sse > 1e-10 * whole), sse)}
    if model.kind == "scale":
        gg, yg = F.sum(n * basis * basis), F.sum(n * mean * basis)
        factor = yg / F.when(gg > 0, gg)
        return {"_lin": factor, "_sse": F.sum(F.col("ss") + n * mean * mean) - factor * yg}
    return {"_lin": F.lit(0.0), "_sse": F.sum(F.col("ss") + n * gap * gap)}


def lattice_fit(
    sums: DataFrame,
    keys: Sequence[str],
    model: str,
    lattice: Mapping[str, tuple[float, float, int]] | None = None,
) -> DataFrame:
    """Best lattice point per group: shape parameters, linear parameter, n and sse.

    The lattice is exploded next to each per-x row. Rows are spread by group and all
    parameters but the last before that one is exploded: the scores then need no
    further shuffle, and even one dominant group is shared by many tasks. Ties go to
    the smallest parameters in the order of the model's shape.
    """
    m = MODELS[model]
    _free_names(m, keys)
    ranges = {**m.lattice, **(lattice or {})}
    rows = sums
    for name in m.shape[:-1]:
        rows = rows.withColumn(name, F.explode(sequence_points(*ranges[name])))
    rows = spread_out(rows, *keys, *m.shape[:-1])
    rows = rows.withColumn(m.shape[-1], F.explode(sequence_points(*ranges[m.shape[-1]])))
    basis = m.basis(F.col("x"), {s: F.col(s) for s in m.shape})
    parts = _linear_part(m, basis)
    scored = rows.groupBy(*keys, *m.shape).agg(
        parts["_lin"].alias("_lin"), parts["_sse"].alias("_sse"), F.sum("n").alias("_n")
    )
    usable = F.col("_sse").isNotNull() & ~F.isnan("_sse")
    best = F.min_by(
        F.struct(*m.shape, "_lin", "_sse", "_n"),
        F.when(usable, F.struct("_sse", *m.shape)),
    )
    linear = [] if m.linear == "none" else [F.col("_b._lin").alias(m.linear)]
    return scored.groupBy(*keys).agg(best.alias("_b")).select(
        *keys,
        *[F.col(f"_b.{s}").alias(s) for s in m.shape],
        *linear,
        F.col("_b._n").alias("n"),
        F.col("_b._sse").alias("sse"),
    )


def refine_fit(
    sums: DataFrame,
    start: DataFrame,
    keys: Sequence[str],
    model: str,
    steps: int = MAX_STEPS,
    tolerance: float = 1e-8,
) -> DataFrame:
    """Improve the shape parameters of one model until every group has settled."""
    return refine_fits(sums, {model: start}, keys, steps, tolerance)[model]


def refine_fits(
    sums: DataFrame,
    starts: Mapping[str, DataFrame],
    keys: Sequence[str],
    steps: int = MAX_STEPS,
    tolerance: float = 1e-8,
) -> dict[str, DataFrame]:
    """Improve the fits of several models by damped Newton and Gauss-Newton steps, each group to its own end.

    A round makes seven trials, in one job for all models: a step with the second derivatives,
    which is fast where residuals are large, Gauss-Newton steps without damping and around that
    of the group, which are safe far from the optimum, and the move before, once and three
    times as long, for optima far along a curved valley. Positive parameters are moved on
    the log scale, where those valleys are straighter. The parameters are joined to the
    per-x table and each trial's residual sum of squares and normal equations are aggregated. The
    best trial that lowers the sum is kept and damping falls; where none does, it rises. Groups
    leave the rounds

    - converged, when the last gain and the gain that the linear model promised are both below
      `tolerance` of the residual sum, when no trial gains and none was promised more, or
      when nothing is left to fit;
    - not converged, when damping has grown so far that no direction is left.

    Only groups that have not settled are in the next round, and rounds end with the last of
    them, or after `steps`. The result has `converged`, the number of `steps` that a group
    took and `status`, which tells whether its start was improved.
    """
    plans = {name: _Rounds(keys, MODELS[name], tolerance) for name in starts}
    width = max(len(MODELS[name].shape) for name in starts)
    state = stored(_together({name: plans[name].begin(sums, start) for name, start in starts.items()}, width))
    ended = [state.where("_settled")]
    for _ in range(steps):
        moving = state.where("NOT _settled")
        left = {row._model for row in moving.select("_model").distinct().collect()}
        if not left:
            break
        rounds = {name: plans[name].step(sums, moving.where(F.col("_model") == name)) for name in starts if name in left}
        state = stored(_together(rounds, width))
        ended.append(state.where("_settled"))
    ended.append(state.where("NOT _settled"))
    every = reduce(DataFrame.unionByName, ended)
    return {name: _refined(every.where(F.col("_model") == name), keys, MODELS[name]) for name in starts}


def fit_models(
    sums: DataFrame,
    keys: Sequence[str],
    lattices: Mapping[str, Mapping[str, tuple[float, float, int]] | None],
    steps: int = 0,
    tolerance: float = 1e-8,
) -> dict[str, DataFrame]:
    """Best lattice point per group and model, with `steps` refined as by `refine_fits`.

    `sums` is a written per-x table. Its groups of at most LOCAL_X rows are packed into a row
    each, which costs one shuffle, and fitted inside tasks; those above go through `lattice_fit`
    and `refine_fits`.
    """
    for model in lattices:
        _free_names(MODELS[model], keys)
    few, rest = _by_size(sums, keys)
    small = _fits_in_tasks(few, keys, lattices, steps, tolerance)
    if rest is None:
        return small
    wide = {model: lattice_fit(rest, keys, model, lattices[model]) for model in lattices}
    if steps:
        wide = refine_fits(rest, wide, keys, steps, tolerance)
    return {model: small[model].unionByName(wide[model]) for model in lattices}


def closed_fits(
    sums: DataFrame,
    keys: Sequence[str],
    lattices: Mapping[str, Mapping[str, tuple[float, float, int]] | None],
    steps: int = MAX_STEPS,
    tolerance: float = 1e-8,
) -> dict[str, DataFrame]:
    """(keys, n, sse, converged) per model: the least residual sum of each family and its limit curves.

    The fits of `fit_models` are searched to their ends in the coordinates of `closing`, from the
    lattice point or from where the rounds ended, whichever is lower there. None is given up:
    a fit has not converged only if its curve has no sum there, and neither did the rounds converge.
    """
    for model in lattices:
        _free_names(MODELS[model], keys)
    few, rest = _by_size(sums, keys)
    out = ["n", "sse", "converged"]
    small = _fits_in_tasks(few, keys, lattices, steps, tolerance, closed=True)
    small = {model: fit.select(*keys, *out) for model, fit in small.items()}
    if rest is None:
        return small
    begun = {model: stored(lattice_fit(rest, keys, model, lattices[model])) for model in lattices}
    ended = refine_fits(rest, begun, keys, steps, tolerance)
    pairs = []
    for model in lattices:
        shape = [*MODELS[model].shape, *[None] * (closing.WIDTH - len(MODELS[model].shape))]
        points = {k: [(F.lit(None).cast("double") if s is None else F.col(s)).alias(f"_{k}{i}") for i, s in enumerate(shape)] for k in "lr"}
        at_end = ended[model].select(*keys, *points["r"], *out, F.lit(model).alias("_model"))
        pairs.append(attach(at_end, begun[model].select(*keys, *points["l"]), keys))
    fits = stored(reduce(DataFrame.unionByName, pairs))
    starts = fits.where("sse IS NOT NULL AND NOT isnan(sse)").drop(*out)
    every = attach(fits, closing.search_wide(rest, starts, keys, tolerance, NOTHING), [*keys, "_model"])
    every = every.withColumns({"sse": F.coalesce("_sse", "sse"), "converged": F.col("converged") | F.col("_sse").isNotNull()})
    wide = {model: every.where(F.col("_model") == model).select(*keys, *out) for model in lattices}
    return {model: small[model].unionByName(wide[model]) for model in lattices}


def _by_size(sums: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The groups of at most LOCAL_X rows, and the others if there are any."""
    sizes = sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    large = stored(sizes.where(F.col("_m") > LOCAL_X).select(*[F.col(k).alias(f"_k_{k}") for k in keys]))
    if large.isEmpty():
        return sums, None
    of_large = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return sums.join(large, of_large, "left_anti"), sums.join(large, of_large, "left_semi")


def _fits_in_tasks(
    sums: DataFrame, keys: Sequence[str], lattices: Mapping, steps: int, tolerance: float, closed: bool = False
) -> dict[str, DataFrame]:
    keys = list(keys)
    width = max(len(MODELS[model].shape) for model in lattices)
    tasks = [
        Task(
            model, MODELS[model].kind, tuple(s in MODELS[model].positive for s in MODELS[model].shape),
            tuple(tuple(spaced(*{**MODELS[model].lattice, **(ranges or {})}[s])) for s in MODELS[model].shape),
        )
        for model, ranges in lattices.items()
    ]
    packed = spread_out(sums, *keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "n", "mean", "ss"))).alias("_xs"))
    numbers = [*[f"_p{i}" for i in range(width)], "_lin", "_sse", "_first"]
    types = ", ".join([*(f"`{k}` {dict(sums.dtypes)[k]}" for k in keys), "_model string"])
    doubles = {c: f"{c} double" for c in numbers}
    order = [*[doubles[f"_p{i}"] for i in range(width)], doubles["_lin"], "_n bigint", doubles["_sse"], doubles["_first"]]
    schema = ", ".join([types, *order, "_converged boolean", "_steps int"])
    found = packed.mapInArrow(lambda b: fits(b, keys, tasks, width, steps, tolerance, NOTHING, FAN, FREE, closed), schema)
    if len(tasks) > 1 or steps:
        found = stored(found)
    return {model: _named(found.where(F.col("_model") == model), keys, MODELS[model], bool(steps)) for model in lattices}


def _named(found: DataFrame, keys: Sequence[str], m: CurveModel, refined: bool) -> DataFrame:
    """Fits with the columns of `lattice_fit`, or of `refine_fits`."""
    state = ["_sse", "_first", "_converged", "_steps"]
    linear = [] if m.linear == "none" else ["_lin"]
    out = found.select(*keys, *[F.col(f"_p{i}").alias(s) for i, s in enumerate(m.shape)], *linear, F.col("_n").alias("n"), *state)
    out = out.withColumnsRenamed({"_lin": m.linear}).withColumn("sse", F.col("_sse"))
    if refined:
        out = out.withColumn("status", _status()).withColumnsRenamed({"_converged": "converged", "_steps": "steps"})
    return out.drop(*state)


def _status() -> Column:
    improved = F.col("_sse") < F.col("_first") * (1 - 1e-12)
    return F.when(improved, F.lit("improved")).otherwise(F.lit("start"))


def _free_names(m: CurveModel, keys: Sequence[str]) -> None:
    clash = {*m.shape, m.linear, "n", "sse"} & set(keys)
    if clash:
        raise ValueError(f"rename the key columns {sorted(clash)}: the fit has columns of that name")


def _refined(state: DataFrame, keys: Sequence[str], m: CurveModel) -> DataFrame:
    linear = [] if m.linear == "none" else [F.col("_lin").alias(m.linear)]
    return state.select(
        *keys,
        *[(_unlog(F.col(f"_p{i}")) if s in m.positive else F.col(f"_p{i}")).alias(s) for i, s in enumerate(m.shape)],
        *linear,
        F.col("_n").alias("n"),
        F.col("_sse").alias("sse"),
        _status().alias("status"),
        F.col("_converged").alias("converged"),
        F.col("_steps").alias("steps"),
    )


def _unlog(v: Column) -> Column:
    """Back from the log scale; bounded, so that nothing is divided by 0."""
    return F.exp(F.least(F.greatest(v, F.lit(-300.0)), F.lit(300.0)))


def _system_names(p: int) -> list[str]:
    """Gauss-Newton matrix, what second derivatives add to it, and right side."""
    pairs = [f"{i}{j}" for i in range(p) for j in range(i, p)]
    return [f"_a{k}" for k in pairs] + [f"_b{k}" for k in pairs] + [f"_r{i}" for i in range(p)]


def _together(tables: Mapping[str, DataFrame], width: int) -> DataFrame:
    """States of several models under each other; models with fewer parameters have nulls."""
    names = [f"_{k}{i}" for k in "pz" for i in range(width)] + _system_names(width)
    nothing = F.lit(None).cast("double")
    wide = [
        t.withColumns({c: nothing for c in names if c not in t.columns}).withColumn("_model", F.lit(name))
        for name, t in tables.items()
    ]
    return reduce(DataFrame.unionByName, wide)


class _Rounds:
    """Begins and steps of one model; their expressions are built once and used in every round."""

    def __init__(self, keys: Sequence[str], m: CurveModel, tolerance: float):
        self.keys, self.m, self.p = list(keys), m, len(m.shape)
        self.points = [f"_p{i}" for i in range(self.p)]
        self.tries = [f"_t{i}" for i in range(self.p)]
        self.system = _system_names(self.p)
        self._evaluation()
        self._fan()
        self._choice(tolerance)

    def begin(self, sums: DataFrame, start: DataFrame) -> DataFrame:
        """The state of every group at its start."""
        at = [F.log(s) if s in self.m.positive else F.col(s) for s in self.m.shape]
        here = start.select(*self.keys, *[v.alias(p) for v, p in zip(at, self.points, strict=True)], F.col("sse").alias("_first"))
        tried = here.select(*self.keys, *[F.col(p).alias(t) for p, t in zip(self.points, self.tries, strict=True)])
        at = attach(here, self.evaluate(sums, tried, self.tries).drop(*self.tries), self.keys)
        usable = F.col("_sse").isNotNull() & ~F.isnan("_sse")
        exact = F.col("_sse") <= NOTHING * F.col("_size")
        return at.withColumns(
            {
                **{f"_z{i}": F.lit(0.0) for i in range(self.p)},
                "_damp": F.lit(0.03),
                "_steps": F.lit(0),
                "_settled": ~usable | exact,
                "_converged": usable & exact,
            }
        )

    def step(self, sums: DataFrame, state: DataFrame) -> DataFrame:
        """Try the fan of steps in every group, keep the best, tell who has settled."""
        fan = state.select(*self.fan).withColumns(self.weights).withColumns(self.gram).withColumns(self.moves)
        found = self.evaluate(sums, fan.select(*self.tried), self.carried)
        best = found.groupBy(*self.keys).agg(*self.best)
        return attach(state, best, self.keys).withColumns(self.verdict).withColumns(self.ends).select(*self.next)

    def evaluate(self, sums: DataFrame, tried: DataFrame, by: Sequence[str]) -> DataFrame:
        """Residual sum, linear parameter and normal equations at the points `_t0`, ... of `tried`.

        Positive parameters are given by their logs. `by` names the columns of `tried` that go through the aggregation.
        """
        rows = attach(sums, tried, self.keys, "inner").withColumns(self.derived).withColumns(self.slopes)
        found = rows.groupBy(*self.keys, *by).agg(*self.sums)
        return found.select(*self.keys, *by, "_lin", "_sse", "_n", "_size", *self.normal)

    def _evaluation(self) -> None:
        m, p, c = self.m, self.p, F.col
        at = dict(zip(m.shape, map(c, self.tries), strict=True))
        x, n, mean, g = c("x"), c("n"), c("mean"), c("_g")
        h = {s: F.lit(1e-4) if s in m.positive else F.greatest(F.abs(at[s]), F.lit(1e-3)) * 1e-4 for s in m.shape}

        def curve(**shift: Column) -> Column:
            moved = {s: at[s] + shift[s] if s in shift else at[s] for s in m.shape}
            return m.basis(x, {s: _unlog(v) if s in m.positive else v for s, v in moved.items()})

        self.derived, self.slopes = {"_g": curve()}, {}
        for i, s in enumerate(m.shape):
            self.derived[f"_up{i}"] = curve(**{s: h[s]})
            self.derived[f"_dn{i}"] = curve(**{s: -h[s]})
        for i, s in enumerate(m.shape):
            up, down = c(f"_up{i}"), c(f"_dn{i}")
            self.slopes[f"_d{i}"] = (up - down) / (2 * h[s])
            self.slopes[f"_e{i}{i}"] = (up - 2 * g + down) / (h[s] * h[s])
            for j in range(i + 1, p):
                t = m.shape[j]
                corners = curve(**{s: h[s], t: h[t]}) + curve(**{s: -h[s], t: -h[t]})
                sides = up + down + c(f"_up{j}") + c(f"_dn{j}")
                self.slopes[f"_e{i}{j}"] = (corners - sides + 2 * g) / (2 * h[s] * h[t])
        d = [c(f"_d{i}") for i in range(p)]
        parts = _linear_part(m, g)
        self.sums = [
            parts["_lin"].alias("_lin"),
            parts["_sse"].alias("_sse"),
            F.sum(n).alias("_n"),
            F.sum(n * (mean - g)).alias("_gap"),
            F.sum(n * g * g).alias("_gg"),
            F.sum(c("ss") + n * mean * mean).alias("_size"),
        ]
        for i in range(p):
            self.sums += [
                F.sum(n * d[i]).alias(f"_s{i}"),
                F.sum(n * d[i] * g).alias(f"_h{i}"),
                F.sum(n * d[i] * mean).alias(f"_w{i}"),
            ]
            for j in range(i, p):
                e = c(f"_e{i}{j}")
                self.sums += [
                    F.sum(n * d[i] * d[j]).alias(f"_q{i}{j}"),
                    F.sum(n * (mean - g) * e).alias(f"_u{i}{j}"),
                    F.sum(n * (e if m.kind == "offset" else g * e)).alias(f"_v{i}{j}"),
                ]
        new, lin = {}, c("_lin")
        some = F.when(c("_gg") > 0, c("_gg"))
        for i in range(p):
            right = c(f"_w{i}") - c(f"_h{i}")
            if m.kind == "offset":  # the constant takes the mean out of every column
                right = right - c(f"_s{i}") * c("_gap") / c("_n")
            elif m.kind == "scale":  # the factor takes the curve itself out of every column
                right = lin * (c(f"_w{i}") - c(f"_h{i}") * lin)
            new[f"_r{i}"] = right
            for j in range(i, p):
                q, bend = c(f"_q{i}{j}"), -c(f"_u{i}{j}")
                if m.kind == "offset":
                    q = q - c(f"_s{i}") * c(f"_s{j}") / c("_n")
                    bend = bend + lin * c(f"_v{i}{j}")
                elif m.kind == "scale":
                    bend = lin * (bend - (1 - lin) * c(f"_v{i}{j}"))
                    slack = [c(f"_w{k}") - lin * c(f"_h{k}") for k in (i, j)]
                    along = [lin * c(f"_h{k}") for k in (i, j)]
                    bend = bend + (along[0] * slack[1] + slack[0] * along[1] - slack[0] * slack[1]) / some
                    q = lin * lin * (q - c(f"_h{i}") * c(f"_h{j}") / some)
                new[f"_a{i}{j}"] = q
                new[f"_b{i}{j}"] = bend
        self.normal = [v.alias(k) for k, v in new.items()]

    def _fan(self) -> None:
        p, c = self.p, F.col
        rows = [F.struct(F.lit(i).alias("_cand"), *map(F.lit, trial)) for i, trial in enumerate(FAN)]
        last = [f"_z{i}" for i in range(p)]
        self.fan = [
            *map(c, [*self.keys, *self.points, *last, *self.system, "_damp"]),
            F.inline(F.array(*rows)).alias("_cand", "_way", "_f", "_own"),
        ]
        # a parameter without any influence stays where it is
        self.weights = {f"_k{i}": F.when(c(f"_a{i}{i}") > 0, c(f"_a{i}{i}")).otherwise(F.lit(1.0)) for i in range(p)}
        self.weights["_damped"] = F.when(c("_own"), c("_damp") * c("_f")).otherwise(c("_f"))
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        bent = F.when(c("_way") == "newton", F.lit(1.0)).otherwise(F.lit(0.0))
        self.gram = {
            f"_k{i}{j}": (c(f"_k{i}") * (1 + c("_damped")) if i == j else c(f"_a{i}{j}")) + bent * c(f"_b{i}{j}")
            for i, j in pairs
        }
        solved = solve_symmetric({k: c(f"_k{k[0]}{k[1]}") for k in pairs}, [c(f"_r{i}") for i in range(p)], tolerance=1e-14)
        self.moves = {
            f"_m{i}": F.when(c("_way") == "again", c("_f") * c(f"_z{i}")).when(~F.isnan(mv), mv) for i, mv in enumerate(solved)
        }
        promise = sum((c(f"_m{i}") * (c(f"_r{i}") + c("_damped") * c(f"_k{i}") * c(f"_m{i}")) for i in range(p)), F.lit(0.0))
        length = F.greatest(*[F.abs(c(f"_m{i}")) / (F.abs(c(f"_p{i}")) + 1e-6) for i in range(p)], F.lit(0.0))
        self.tried = [
            *map(c, [*self.keys, "_cand"]),
            F.when(c("_own"), c("_f")).alias("_f"),
            *[(c(f"_p{i}") + F.coalesce(c(f"_m{i}"), F.lit(0.0))).alias(f"_t{i}") for i in range(p)],
            F.when(c("_way") != "again", promise).alias("_promise"),
            F.when(c("_m0").isNotNull(), length).alias("_length"),
        ]
        self.carried = ["_cand", "_f", "_promise", "_length", *self.tries]

    def _choice(self, tolerance: float) -> None:
        c = F.col
        usable = c("_sse").isNotNull() & ~F.isnan("_sse")
        self.best = [
            F.min_by(
                F.struct("_f", "_promise", *self.tries, "_lin", "_sse", *self.system), F.when(usable, F.struct("_sse", "_cand"))
            ).alias("_b"),
            F.max(F.when(c("_cand") == FREE, F.struct("_promise", "_length"))).alias("_free"),
        ]
        ok = c("_b").isNotNull() & (c("_b._sse") < c("_sse"))
        small = tolerance * c("_sse")
        no = F.lit(False)
        unpromising = F.coalesce(c("_free._promise") <= small, no)
        gained = c("_ok") & (c("_sse") - c("_b._sse") <= small) & (unpromising | F.coalesce(F.abs(c("_b._promise")) <= small, no))
        flat = ~c("_ok") & (unpromising | F.coalesce(c("_free._length") <= tolerance, no))
        exact = c("_ok") & (c("_b._sse") <= NOTHING * c("_size"))
        self.verdict = {"_ok": F.coalesce(ok, no)}
        self.ends = {"_end": gained | flat | exact, "_stuck": ~c("_ok") & (c("_damp") > 1e10)}
        now = {p: F.when(c("_ok"), c(f"_b.{t}")).otherwise(c(p)) for p, t in zip(self.points, self.tries, strict=True)}
        now |= {
            f"_z{i}": F.when(c("_ok"), c(f"_b.{t}") - c(f"_p{i}")).otherwise(c(f"_z{i}")) for i, t in enumerate(self.tries)
        }
        now |= {k: F.when(c("_ok"), c(f"_b.{k}")).otherwise(c(k)) for k in ["_lin", "_sse", *self.system]}
        eased = F.greatest(c("_damp") * F.coalesce(c("_b._f"), F.lit(0.3)) * 0.3, F.lit(1e-9))
        self.next = [
            *map(c, self.keys),
            *[v.alias(k) for k, v in now.items()],
            *map(c, ["_n", "_size", "_first"]),
            F.when(c("_ok"), eased).otherwise(c("_damp") * 100).alias("_damp"),
            (c("_steps") + 1).alias("_steps"),
            (c("_end") | c("_stuck")).alias("_settled"),
            c("_end").alias("_converged"),
        ]


def grouped_nonlinear(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    model: str = "lactin2",
    lattice: Mapping[str, tuple[float, float, int]] | None = None,
    steps: int = 0,
) -> DataFrame:
    """Fit a curve model per group: lattice, then refinement to tolerance in at most `steps` rounds."""
    return fit_models(stored(per_x_sums(df, keys, x, y)), keys, {model: lattice}, steps)[model]


def nonlinear_points(
    params: DataFrame, keys: Sequence[str], model: str, points: Column, x: str = "x"
) -> DataFrame:
    """Evaluate fitted nonlinear curves on an array of x points."""
    m = MODELS[model]
    rows = params.withColumn(x, F.explode(points))
    value = m.basis(F.col(x), {s: F.col(s) for s in m.shape})
    if m.kind == "offset":
        value = value + F.col(m.linear)
    elif m.kind == "scale":
        value = value * F.col(m.linear)
    return rows.select(*keys, x, value.alias("fit"))


def compare_models(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    curves: Sequence[str] = ("lactin2", "theta_logistic", "briere1", "briere2"),
    lattices: Mapping[str, Mapping[str, tuple[float, float, int]]] | None = None,
    steps: int = MAX_STEPS,
    shift: float = 0.0,
) -> DataFrame:
    """(keys, model, n, sse, converged, aic, best) for polynomial and nonlinear curve families.

    Polynomials share one aggregation of the rows, nonlinear models one per-x table and the
    rounds of their refinement. After `steps` rounds every fit is searched to its end as by
    `closed_fits`, so no curve form is passed over for want of iterations, and a family whose best
    curve is a limit counts with that. `best` is the least AIC among converged fits. With `steps` 0
    the nonlinear fits are lattice points, `converged` is null for them, and all fits are ranked.
    """
    names = {"quadratic": 2, "cubic": 3}
    stats = scaled_moments(df, keys, x, y, 3)
    entries = []
    for name, degree in names.items():
        slopes = _slopes(degree)
        sse = F.when(slopes[0].isNotNull(), _sse(_explained(slopes)))
        entries.append(F.struct(F.lit(name).alias("model"), sse.alias("sse"), F.lit(degree + 2).alias("_k")))
    table = stats.select(*keys, "n", F.inline(F.array(*entries)))
    fractional = fractional_moments(df, keys, x, y, shift)
    slopes = _slopes(3)
    table = table.unionByName(
        fractional.select(
            *keys, "n", F.lit("fractional").alias("model"),
            F.when(slopes[0].isNotNull(), _sse(_explained(slopes))).alias("sse"), F.lit(5).alias("_k"),
        )
    ).withColumn("converged", F.col("sse").isNotNull())
    if curves:
        sums = stored(per_x_sums(df, keys, x, y))
        ranges = {model: (lattices or {}).get(model) for model in curves}
        fitted = closed_fits(sums, keys, ranges, steps) if steps else fit_models(sums, keys, ranges)
        for model, fit in fitted.items():
            k = len(MODELS[model].shape) + (0 if MODELS[model].kind == "fixed" else 1) + 1
            converged = F.col("converged") if steps else F.lit(None).cast("boolean")
            table = table.unionByName(
                fit.select(*keys, "n", F.lit(model).alias("model"), "sse", F.lit(k).alias("_k"), converged.alias("converged"))
            )
    scored = table.withColumn("aic", aic(F.col("n"), F.col("sse"), F.col("_k"))).drop("_k")
    ranked = F.col("aic").isNotNull() & F.coalesce(F.col("converged"), F.lit(True))
    best = scored.where(ranked).groupBy(*keys).agg(
        F.min_by("model", F.struct("aic", "model")).alias("best")
    )
    return attach(scored, best, keys)
