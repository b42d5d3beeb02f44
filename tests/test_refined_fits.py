"""Nonlinear fits brought to tolerance, against dense searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvewise.operators import nonlinear

CURVES = {
    "lactin2": lambda x, p, tmax, dt: np.exp(p * x) - np.exp(p * tmax - (tmax - x) / dt),
    "theta_logistic": lambda x, k, theta: x * (1 - (x / k) ** theta),
    "briere1": lambda x, t0, tm: np.where((x > t0) & (x < tm), x * (x - t0) * np.sqrt(np.maximum(tm - x, 0)), 0.0),
}
TRUE = {"lactin2": (0.11, 33.0, 6.0), "theta_logistic": (31.0, 2.5), "briere1": (4.0, 34.0)}


def residual(model, x, y, point):
    g = CURVES[model](x, *point)
    if model == "lactin2":
        return y - g - (y - g).mean()
    return y - g * ((g * y).sum() / (g * g).sum())


def dense_optimum(model, x, y):
    """Damped steps with numerical slopes from many starts near the truth."""
    best = np.inf
    rng = np.random.default_rng(0)
    for _ in range(12):
        point, damp = np.array(TRUE[model]) * rng.uniform(0.97, 1.03, len(TRUE[model])), 1e-3
        r = residual(model, x, y, point)
        for _ in range(200):
            h = 1e-6 * np.abs(point)
            jac = np.column_stack(
                [(residual(model, x, y, point + h * e) - residual(model, x, y, point - h * e)) / (2 * h[k]) for k, e in enumerate(np.eye(len(point)))]
            )
            a = jac.T @ jac
            move = np.linalg.solve(a + damp * np.diag(np.diag(a)), -jac.T @ r)
            new = residual(model, x, y, point + move)
            if new @ new < r @ r:
                point, r, damp = point + move, new, damp / 5
            else:
                damp *= 5
        best = min(best, r @ r)
    return best


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(np.arange(12.0, 31.0, 1.5), 6)
    rows, data = [], {}
    for model, true in TRUE.items():
        scale = {"lactin2": 1.0, "theta_logistic": 0.1, "briere1": 2e-4}[model]
        clean = CURVES[model](x, *true) * scale + (0.3 if model == "lactin2" else 0.0)
        for g in range(3):
            y = clean + rng.normal(0, 0.03 * (g + 1), len(x))
            data[model, g] = (x, y)
            rows += [(model, g, float(a), float(b)) for a, b in zip(x, y, strict=True)]
    return data, spark.createDataFrame(rows, "model string, g int, x double, y double")


@pytest.mark.parametrize("model", list(CURVES))
def test_refined_fits_reach_the_dense_optimum(made, model):
    data, df = made
    got = nonlinear.grouped_nonlinear(df.where(F.col("model") == model), ["g"], "x", "y", model, steps=nonlinear.MAX_STEPS).collect()
    assert len(got) == 3
    for r in got:
        x, y = data[model, r.g]
        assert r.converged and 0 < r.steps < nonlinear.MAX_STEPS
        found = residual(model, x, y, [r[s] for s in nonlinear.MODELS[model].shape])
        assert r.sse == pytest.approx(found @ found, rel=1e-7)
        assert r.sse == pytest.approx(dense_optimum(model, x, y), rel=1e-7)


def test_groups_end_on_their_own_and_say_so(spark, made):
    """An exact curve, a noisy one, one with two x only, and a null key; one round is too few for the noisy one."""
    data, df = made
    noisy = df.where("model = 'lactin2' AND g = 2").select(F.lit("noisy").alias("key"), "x", "y")
    exact = noisy.select(F.lit(None).cast("string").alias("key"), "x", (F.exp(0.11 * F.col("x")) - F.exp(0.11 * 33 - (33 - F.col("x")) / 6)).alias("y"))
    few = noisy.where("x < 14").withColumn("key", F.lit("few"))
    both = noisy.unionByName(exact).unionByName(few)
    fits = {r.key: r for r in nonlinear.grouped_nonlinear(both, ["key"], "x", "y", "lactin2", steps=nonlinear.MAX_STEPS).collect()}
    assert set(fits) == {"noisy", None, "few"}
    assert fits["noisy"].converged and fits[None].converged
    assert fits[None].sse < 1e-10 and fits[None].tmax == pytest.approx(33, rel=1e-4)
    one = nonlinear.grouped_nonlinear(noisy, ["key"], "x", "y", "lactin2", steps=1).first()
    assert one.steps == 1 and not one.converged and one.sse >= fits["noisy"].sse


def test_families_are_ranked_by_converged_fits(made):
    _, df = made
    rows = nonlinear.compare_models(df.where("model = 'briere1'"), ["g"], "x", "y", curves=("theta_logistic", "briere1")).collect()
    for g in range(3):
        part = {r.model: r for r in rows if r.g == g}
        assert set(part) == {"quadratic", "cubic", "fractional", "theta_logistic", "briere1"}
        able = [r for r in part.values() if r.converged]
        assert part["briere1"].converged
        assert {r.best for r in part.values()} == {min(able, key=lambda r: r.aic).model}
    lattice = nonlinear.compare_models(df.where("model = 'briere1'"), ["g"], "x", "y", curves=("briere1",), steps=0)
    assert {r.converged for r in lattice.where("model = 'briere1'").collect()} == {None}
