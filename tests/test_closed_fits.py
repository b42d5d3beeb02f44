"""Families with their limit curves: every fit ends, at sums that dense searches confirm."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvewise.operators import closing, nonlinear

LATTICES = {
    "lactin2": {"p": (0.05, 0.25, 5), "tmax": (11.0, 16.0, 6), "dt": (1.0, 4.0, 4)},
    "theta_logistic": {"k": (11.0, 20.0, 10), "theta": (0.5, 3.0, 6)},
    "briere1": {"t0": (-6.0, -1.0, 6), "tm": (10.5, 20.0, 6)},
    "briere2": {"t0": (-6.0, -1.0, 6), "tm": (10.5, 20.0, 6), "m": (1.0, 4.0, 4)},
}
X = np.repeat(np.arange(11.0), 2)


@pytest.fixture(scope="module")
def groups(spark):
    """Level noise, where all four families run away, curves of two limits, and a group of x = 0 only."""
    rng = np.random.default_rng(2)
    made = {f"noise{g}": 10 + rng.normal(0, 0.5, len(X)) for g in range(4)}
    made["gompertz"] = 3 * X * (2.5 - np.log(np.maximum(X, 1e-9))) + rng.normal(0, 0.5, len(X))
    made["ricker"] = 20 * X * np.exp(-0.3 * X) + rng.normal(0, 0.5, len(X))
    rows = [(key, float(a), float(b)) for key, y in made.items() for a, b in zip(X, y, strict=True)]
    rows += [("zero", 0.0, 1.0), ("zero", 0.0, 2.0)] + [(None, a, b) for key, a, b in rows if key == "noise0"]
    return made, spark.createDataFrame(rows, "key string, x double, y double")


@pytest.fixture(scope="module")
def compared(groups):
    rows = nonlinear.compare_models(groups[1], ["key"], "x", "y", lattices=LATTICES, steps=2, shift=1.0).collect()
    return {(r.key, r.model): r for r in rows}


def left(columns, y):
    """Residual sum of a least squares fit."""
    a = np.column_stack(columns)
    return float(((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).sum())


def test_no_family_is_passed_over_for_want_of_rounds(groups, compared):
    for key in [*groups[0], None]:
        part = {m: r for (k, m), r in compared.items() if k == key}
        assert len(part) == 7 and all(r.converged for r in part.values())
        assert {r.best for r in part.values()} == {min(part.values(), key=lambda r: r.aic).model}
        assert all(part[m].sse == pytest.approx(compared["noise0", m].sse) for m in LATTICES) or key is not None
    assert compared["ricker", "briere1"].best == "briere2"
    assert compared["gompertz", "briere1"].best == "theta_logistic"
    assert all(compared["zero", m].sse is None for m in ("theta_logistic", "briere1", "briere2"))


def test_limit_curves_are_reached(groups, compared):
    """theta = 0 in closed form, t0 = -inf and tm = inf from a dense grid."""
    made, _ = groups
    logs = X * np.log(np.maximum(X, 1e-300))
    for key, y in made.items():
        thetas = [left([X, X * (X**t - 1) / t], y) for t in np.geomspace(1e-4, 50, 4000)]
        assert compared[key, "theta_logistic"].sse <= min(min(thetas), left([X, logs], y)) * (1 + 1e-6)
        ricker = min(left([X * np.exp(-c * X)], y) for c in np.linspace(0, 2, 4001))
        assert compared[key, "briere2"].sse <= ricker * (1 + 1e-6)
        root = min(left([X * np.sqrt(np.maximum(tm - X, 0))], y) for tm in np.geomspace(10.01, 1e5, 4000))
        assert compared[key, "briere1"].sse <= root * (1 + 1e-6)
    assert compared["gompertz", "theta_logistic"].sse == pytest.approx(left([X, logs], made["gompertz"]), rel=0.1)


def test_sums_are_of_true_curves(groups, compared):
    """No curve is below the sum within x; on the way to a limit, rounding once gave such sums."""
    made, _ = groups
    for key, y in made.items():
        within = sum(((y[x == X] - y[x == X].mean()) ** 2).sum() for x in np.unique(X))
        assert all(compared[key, m].sse > within * (1 + 1e-9) for m in LATTICES)
        # at theta near 0 the curves are nearly those of the limit, so a far lower sum is none
        best = min(left([X, X * (X**t - 1) / t], y) for t in np.geomspace(1e-5, 50, 4000))
        assert compared[key, "theta_logistic"].sse >= best * (1 - 1e-3)


def test_tasks_and_aggregations_agree(groups, monkeypatch):
    sums = nonlinear.stored(nonlinear.per_x_sums(groups[1].where("key IN ('ricker', 'zero')"), ["key"], "x", "y"))

    def all_fits():
        return {r.key: r for r in nonlinear.closed_fits(sums, ["key"], {"briere2": LATTICES["briere2"]}, 1, 1e-3)["briere2"].collect()}

    mine = all_fits()
    monkeypatch.setattr(nonlinear, "LOCAL_X", 0)
    wide = all_fits()
    assert set(mine) == set(wide) == {"ricker", "zero"}
    assert wide["ricker"].converged and wide["ricker"].sse == pytest.approx(mine["ricker"].sse, rel=1e-3)
    assert wide["zero"].sse is None and not wide["zero"].converged and wide["zero"].n == mine["zero"].n == 2


def test_curves_are_the_same_for_arrays_and_columns(spark):
    """Points all over the coordinates, their ends included."""
    rng, rows = np.random.default_rng(9), []
    for model, size in closing.SIZE.items():
        z = np.where(rng.random((size, 60)) < 0.2, rng.integers(0, 2, (size, 60)), rng.random((size, 60)))
        one = {"_reach": 10.0, "_low": 1.0, "_high": 10.0, "_unit": 2.0, "_size": 1.0}
        with np.errstate(all="ignore"):
            c = closing.numbers(model, z, {k: np.full(60, v) for k, v in one.items()})
            for i in range(60):
                x = float(rng.integers(0, 11))
                group = {k: np.array([v]) for k, v in one.items()}
                parts = closing.columns(model, closing.Arrays, np.array([x]), group, c[:, i : i + 1])
                want = [0.0 if v is None else float(v[0]) for v in parts]
                rows.append((model, x, *one.values(), *[float(v) for v in c[:, i]], *[0.0] * (3 - len(c)), 1.0, 0.5, 0.0, *want))
    names = ["_model", "x", *closing.FACTS, "_c0", "_c1", "_c2", "n", "mean", "ss", "w0", "w1", "w2"]
    made, _ = closing._expressions(list(closing.SIZE))
    for r in spark.createDataFrame(rows, names).withColumns(made).collect():
        for got, want in ((r._v0, r.w0), (r._v1, r.w1), (r._y, 0.5 - r.w2)):
            assert got == pytest.approx(want, rel=1e-9, abs=1e-12, nan_ok=True), r


@pytest.mark.parametrize("model", list(LATTICES))
def test_coordinates_stand_for_the_same_curves(model):
    rng = np.random.default_rng(4)
    bounds = {**LATTICES, "lactin2": {"p": (0.05, 0.25, 5), "tmax": (11.0, 16.0, 6), "dt": (5.0, 30.0, 4)}}[model]
    points = np.array([rng.uniform(low, high, 50) for low, high, _ in bounds.values()])
    every = np.ones(50)
    group = {"_reach": 10 * every, "_low": every, "_high": 10 * every, "_unit": 3 * every, "_size": every}
    c = closing.numbers(model, closing.coordinates(model, points, group), group)
    x = np.arange(1.0, 11.0)
    for i in range(50):
        one = {k: v[i] for k, v in group.items()}
        v0, v1, fixed = closing.columns(model, closing.Arrays, x, one, c[:, i])
        p = points[:, i]
        y = {
            "lactin2": lambda p=p: np.exp(p[0] * x) - np.exp(p[0] * p[1] - (p[1] - x) / p[2]),
            "theta_logistic": lambda p=p: x * (1 - (x / p[0]) ** p[1]),
            "briere1": lambda p=p: x * (x - p[0]) * np.sqrt(p[1] - x),
            "briere2": lambda p=p: x * (x - p[0]) * (p[1] - x) ** (1 / p[2]),
        }[model]()
        rest = y - (0 if fixed is None else fixed)
        assert left([v for v in (v0, v1) if v is not None], rest) <= 1e-16 * (y @ y + rest @ rest) * len(x)


def test_a_noisy_curve_keeps_its_fit(spark):
    """Where the rounds reach an inner optimum, the search ends there too."""
    rng = np.random.default_rng(7)
    x = np.repeat(np.arange(12.0, 31.0, 1.5), 4)
    y = np.exp(0.11 * x) - np.exp(0.11 * 33 - (33 - x) / 6) + 0.3 + rng.normal(0, 0.05, len(x))
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)], "k int, x double, y double")
    by_rounds = nonlinear.grouped_nonlinear(df, ["k"], "x", "y", "lactin2", steps=nonlinear.MAX_STEPS).first()
    searched = nonlinear.compare_models(df, ["k"], "x", "y", curves=("lactin2",)).where(F.col("model") == "lactin2").first()
    assert by_rounds.converged and searched.sse == pytest.approx(by_rounds.sse, rel=1e-7)
