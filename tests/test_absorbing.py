"""Models with absorbed factors against dense least squares with one column per level."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvewise.operators import absorbing
from curvewise.operators.linear import effect_sizes


def table(seed=1, n=400, split=False, third=False):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 6, n), rng.integers(0, 9, n)
    if split:  # two parts that share no level
        b = np.where(a < 3, b % 4, 4 + b % 5)
    c = rng.integers(0, 3, n)
    x1 = rng.normal(50, 3, n) + a
    x2 = 0.3 * x1 + rng.normal(0, 1, n)
    y = 100 + 2 * np.sin(a) + 0.5 * b - 0.7 * x1 + 0.2 * x2 + (c if third else 0) + rng.normal(0, 0.5, n)
    return pd.DataFrame({"a": a, "b": [f"b{v}" for v in b], "c": c, "x1": x1, "x2": x2, "fixed": a * 1.5, "y": y})


def dense(pdf, factors, covariates):
    parts = [np.ones((len(pdf), 1)), *[pd.get_dummies(pdf[f].astype(str)).to_numpy(float) for f in factors]]
    design = np.hstack([*parts, (pdf[covariates] - pdf[covariates].mean()).to_numpy()])
    beta, *_ = np.linalg.lstsq(design, pdf.y, rcond=1e-10)
    sse, rank = float(((pdf.y - design @ beta) ** 2).sum()), int(np.linalg.matrix_rank(design))
    cov = np.linalg.pinv(design.T @ design, rcond=1e-12) * sse / (len(pdf) - rank)
    k = len(covariates)
    return beta[-k:] if k else [], np.sqrt(np.diag(cov))[-k:] if k else [], sse, rank, design @ beta


@pytest.mark.parametrize(
    ("factors", "options"),
    [(["a"], {}), (["a", "b"], {"split": True}), (["a", "b", "c"], {"third": True})],
)
def test_estimates_errors_and_rank(spark, factors, options):
    pdf = table(**options)
    fit = absorbing.fit_absorbed(spark.createDataFrame(pdf).repartition(4), "y", factors, ["x1", "x2"])
    beta, se, sse, rank, _ = dense(pdf, factors, ["x1", "x2"])
    assert fit.projection.converged
    assert (fit.n, fit.rank) == (len(pdf), rank)
    assert list(fit.beta) == pytest.approx(list(beta), rel=1e-6)
    assert fit.sse == pytest.approx(sse, rel=1e-8)
    rows = absorbing.tidy_absorbed(spark, fit).collect()
    assert [r.std_error for r in rows] == pytest.approx(list(se), rel=1e-6)


def test_effects_give_the_fitted_values(spark):
    pdf = table(third=True)
    factors = ["a", "b", "c"]
    fit = absorbing.fit_absorbed(spark.createDataFrame(pdf), "y", factors, ["x1"])
    *_, fitted = dense(pdf, factors, ["x1"])
    effects = {(r.factor, r.level): r.effect for r in absorbing.level_effects(fit).collect()}
    got = pdf.y.mean() + fit.beta[0] * (pdf.x1 - pdf.x1.mean())
    for f in factors:
        got = got + pdf[f].astype(str).map({lev: e for (g, lev), e in effects.items() if g == f})
    assert got.to_numpy() == pytest.approx(fitted, abs=1e-6)
    assert len(effects) == 6 + 9 + 3


def test_determined_covariates_and_missing_values(spark):
    pdf = table()
    holes = pd.concat([pdf, pdf.head(3).assign(y=np.nan)])
    df = spark.createDataFrame(holes).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    fit = absorbing.fit_absorbed(df, "y", ["a", "b"], ["fixed", "x1"])
    beta, _, sse, rank, _ = dense(pdf, ["a", "b"], ["x1"])
    assert fit.n == len(pdf) and np.isnan(fit.beta[0]) and fit.beta[1] == pytest.approx(beta[0], rel=1e-6)
    assert (fit.rank, fit.sse) == (rank, pytest.approx(sse, rel=1e-8))
    assert absorbing.tidy_absorbed(spark, fit).first().estimate is None
    with pytest.raises(ValueError, match="no complete rows"):
        absorbing.fit_absorbed(df.where("a > 99"), "y", ["a", "b"])


def test_variance_tables(spark):
    kind, pdf = "sequential", table()
    out = absorbing.anova_absorbed(spark.createDataFrame(pdf), "y", ["a", "b"], ["x1"], kind)
    rows = {r.term: r for r in out.collect()}
    *_, sse0, r0, _ = dense(pdf, [], ["x1"])
    *_, sse_a, ra, _ = dense(pdf, ["a"], ["x1"])
    *_, sse, rank, _ = dense(pdf, ["a", "b"], ["x1"])
    assert (rows["a"].sum_sq, rows["a"].df) == (pytest.approx(sse0 - sse_a, rel=1e-6), ra - r0)
    assert (rows["b"].sum_sq, rows["b"].df) == (pytest.approx(sse_a - sse, rel=1e-6), rank - ra)
    assert (rows["Residuals"].sum_sq, rows["Residuals"].df) == (pytest.approx(sse, rel=1e-8), len(pdf) - rank)
    f = rows["b"].sum_sq / rows["b"].df / (sse / (len(pdf) - rank))
    assert rows["b"].f_value == pytest.approx(f) and 0 <= rows["b"].p_value <= 1
    sizes = {r.term: r for r in effect_sizes(out).collect()}
    assert sizes["b"].eta_sq == pytest.approx(rows["b"].sum_sq / (rows["b"].sum_sq + sse))


def test_marginal_table_of_two_factors(spark):
    pdf = table(n=120)
    rows = {r.term: r for r in absorbing.anova_absorbed(spark.createDataFrame(pdf), "y", ["a", "b"], kind="marginal").collect()}
    *_, sse_b, rb, _ = dense(pdf, ["b"], [])
    *_, sse, rank, _ = dense(pdf, ["a", "b"], [])
    assert (rows["a"].sum_sq, rows["a"].df) == (pytest.approx(sse_b - sse, rel=1e-6), rank - rb)


def test_blocks_share_out_a_large_level(spark, monkeypatch):
    monkeypatch.setattr(absorbing, "MOST_CELLS", 25)
    rng = np.random.default_rng(4)
    n = 500
    a = np.where(rng.random(n) < 0.5, 3, rng.integers(0, 30, n))  # level 3 reaches over several blocks
    b = rng.integers(0, 80, n) + 100 * (a >= 25)  # and two parts share no level
    x1 = rng.normal(0, 1, n) + a
    pdf = pd.DataFrame({"a": a, "b": b, "x1": x1, "y": np.sin(a) + 0.02 * b + 0.5 * x1 + rng.normal(0, 0.1, n)})
    df = spark.createDataFrame(pdf).repartition(4)
    fit = absorbing.fit_absorbed(df, "y", ["a", "b"], ["x1"])
    beta, se, sse, rank, fitted = dense(pdf, ["a", "b"], ["x1"])
    assert absorbing._blocks(fit.projection.cells.select("_f0", "_f1", "n", "_s0", "_s1"), 2, 2)[1] > 8
    assert fit.projection.converged and (fit.n, fit.rank) == (n, rank)
    assert (fit.beta[0], fit.sse) == (pytest.approx(beta[0], rel=1e-6), pytest.approx(sse, rel=1e-8))
    effects = {(r.factor, r.level): r.effect for r in absorbing.level_effects(fit).collect()}
    got = pdf.a.map(lambda v: effects["a", str(v)]) + pdf.b.map(lambda v: effects["b", str(v)]) + fit.beta[0] * pdf.x1
    part = pdf.a >= 25  # the parts differ by an open constant
    for some in (part, ~part):
        assert np.ptp((got - fitted)[some]) < 1e-6
    # the first factor alone, a by-product
    *_, sse_a, rank_a, _ = dense(pdf, ["a"], [])
    first = fit.projection.first
    assert (first.rank, first.residual[0, 0]) == (rank_a, pytest.approx(sse_a, rel=1e-8))


def test_directions_move_and_combinations_stay(spark, monkeypatch):
    """A step exchanges a row per level and block, fewer than there are combinations."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.integers(0, 300, 6000), "b": rng.integers(0, 40, 6000), "y": rng.normal(0, 1, 6000)})
    plans = []
    keep = absorbing.stored
    monkeypatch.setattr(absorbing, "stored", lambda df: plans.append(df) or keep(df))
    found = absorbing.project(spark.createDataFrame(pdf), ["a", "b"], ["y"])
    steps = [df for df in plans if "_q0" in df.columns]
    assert found.converged and len(steps) >= found.steps
    assert found.cells.count() > 4000 and max(df.count() for df in steps) == 40
    for df in steps:  # nothing in a step reads the table of combinations
        assert "_f1" not in df._jdf.queryExecution().optimizedPlan().toString()
