"""Model fits against dense numpy solutions on small made data."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvewise.functions import tails
from curvewise.operators import curves, fitting, linear, mixed, nonlinear, plotting, smooth
from curvewise.operators.joining import sequence_points


@pytest.fixture(scope="module")
def trial(spark):
    """Unbalanced two-factor data with a covariate, unit effects and missing values."""
    rng = np.random.default_rng(11)
    n = 600
    unit = rng.choice(list("abcdefgh"), n, p=[0.3] + [0.1] * 7)
    t, e = rng.choice(["C", "P"], n, p=[0.6, 0.4]), rng.choice(["X", "Z"], n)
    x = rng.choice([13, 16, 20, 24, 28], n)
    u = dict(zip("abcdefgh", rng.normal(0, 1.5, 8), strict=True))
    v = dict(zip("abcdefgh", rng.normal(0, 0.1, 8), strict=True))
    y = (
        3 + 0.8 * x - 0.017 * x**2 + 0.7 * (t == "P") - 0.4 * (e == "Z") + 0.05 * x * (t == "P")
        + np.array([u[k] for k in unit]) + np.array([v[k] for k in unit]) * (x - 20) + rng.normal(0, 1, n)
    )
    y[::37] = np.nan
    pdf = pd.DataFrame({"unit": unit, "t": t, "e": e, "x": x, "y": y, "z": 0.5 * y + rng.normal(0, 1, n)})
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    return pdf.dropna(), df.withColumn("z", F.when(~F.isnan("z"), F.col("z"))).cache()


def test_tails():
    assert tails.f_tail(4.0, 1, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert tails.t_tail(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert tails.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_tail(2.0, 2) == pytest.approx(math.exp(-1.0), abs=1e-12)
    assert tails.t_quantile(0.95, 10) == pytest.approx(2.2281389, abs=1e-6)
    assert tails.f_tail(1e-12, 2, 5) == pytest.approx(1.0)


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_grouped_polynomials(trial, degree):
    pdf, df = trial
    rows = fitting.grouped_poly(df, ["unit", "t"], "x", "y", degree).collect()
    assert len(rows) == 16
    for r in rows:
        part = pdf[(pdf.unit == r.unit) & (pdf.t == r.t)]
        want = np.polynomial.polynomial.polyfit(part.x, part.y, degree)
        at = np.linspace(13, 28, 7)
        got = sum(r[f"b{i}"] * at**i for i in range(degree + 1))
        assert got == pytest.approx(np.polynomial.polynomial.polyval(at, want), abs=1e-6)
        sse = ((part.y - np.polynomial.polynomial.polyval(part.x, want)) ** 2).sum()
        assert r.sse == pytest.approx(sse, rel=1e-6) and r.n == len(part)


def test_too_few_x_values_give_null(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 3.0), (1, 2.0, 4.0)], "k int, x double, y double")
    r = fitting.grouped_poly(df, ["k"], "x", "y", 2).first()
    assert r.b2 is None and r.sse is None and r.n == 3
    assert fitting.grouped_linear(df, ["k"], "x", "y").first().slope == pytest.approx(1.5)


def dense(pdf, design):
    return design.matrix(pdf)


def sse_of(x, y):
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    return float(((y - x @ b) ** 2).sum())


def test_factorial_fit_and_tables(spark, trial):
    pdf, df = trial
    fit = linear.fit_linear(df, "y", linear.crossed("x", "t", "e"), ["t", "e"], {"x": 2})
    x, y = dense(pdf, fit.design), pdf.y.to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    assert fit.beta[:, 0] == pytest.approx(beta, abs=1e-8)
    assert fit.sse == pytest.approx(sse_of(x, y)) and fit.df_resid == len(pdf) - 12
    table = {r.term: r for r in linear.anova_marginal(spark, fit).collect()}
    groups = {
        name: [i for i, (t, _, _) in enumerate(fit.design.columns()) if t >= 0 and ":".join(fit.design.terms[t]) == name]
        for name in table if name != "Residuals"
    }
    for name, own in groups.items():
        higher = [g for other, idx in groups.items() if set(name.split(":")) < set(other.split(":")) for g in idx]
        larger = [i for i in range(12) if i not in higher]
        smaller = [i for i in larger if i not in own]
        ss = sse_of(x[:, smaller], y) - sse_of(x[:, larger], y)
        assert table[name].sum_sq == pytest.approx(ss, rel=1e-6, abs=1e-8)
        assert table[name].df == len(own)
    seq = linear.anova_sequential(spark, fit).collect()
    total = ((y - y.mean()) ** 2).sum()
    assert sum(r.sum_sq for r in seq) == pytest.approx(total)
    sizes = {r.term: r for r in linear.effect_sizes(linear.anova_marginal(spark, fit)).collect()}
    r = table["t"]
    assert sizes["t"].eta_sq == pytest.approx(r.sum_sq / (r.sum_sq + fit.sse))
    assert sizes["t"].omega_sq == pytest.approx((r.sum_sq - r.df * r.mse) / (total + r.mse))


def test_prediction_band(spark, trial):
    pdf, df = trial
    fit = linear.fit_linear(df, "y", linear.crossed("x", "t"), ["t"], {"x": 1})
    x, y = dense(pdf, fit.design), pdf.y.to_numpy()
    cov = np.linalg.inv(x.T @ x) * sse_of(x, y) / (len(y) - 4)
    grid = spark.createDataFrame([(13, "C"), (28, "P")], "x int, t string")
    for r in linear.predict_linear(fit, grid, level=0.95).collect():
        row = dense(pd.DataFrame({"x": [r.x], "t": [r.t]}), fit.design)[0]
        assert r.se == pytest.approx(math.sqrt(row @ cov @ row))
        half = tails.t_quantile(0.95, len(y) - 4) * r.se
        assert (r.lower, r.upper) == (pytest.approx(r.fit - half), pytest.approx(r.fit + half))
    plain = linear.predict_linear(fit, grid).collect()
    assert [r.fit for r in plain] == pytest.approx(
        [r.fit for r in linear.predict_linear(fit, grid, level=0.9).collect()]
    )
    resid = linear.augment_linear(fit, df).agg(F.sum(F.col("resid") ** 2)).first()[0]
    assert resid == pytest.approx(fit.sse)
    assert linear.aic_linear(fit) == pytest.approx(len(y) * math.log(fit.sse / len(y)) + 10)


def test_manova(spark, trial):
    pdf, df = trial
    fit = linear.fit_linear(df, ["y", "z"], linear.crossed("t", "e"), ["t", "e"])
    x, y = dense(pdf, fit.design), pdf[["y", "z"]].to_numpy()

    def ssp(cols):
        b = np.linalg.lstsq(x[:, cols], y, rcond=None)[0]
        r = y - x[:, cols] @ b
        return r.T @ r

    h, e = ssp([0, 1, 2]) - ssp([0, 1, 2, 3]), ssp([0, 1, 2, 3])
    rows = {r.term: r for r in linear.manova(spark, fit).collect()}
    assert rows["t:e"].pillai == pytest.approx(np.trace(h @ np.linalg.inv(h + e)))
    assert (rows["t:e"].num_df, rows["t:e"].den_df) == (2, len(y) - 4 - 1)


def dense_reml(pdf, design, random, theta_cov, sigma2):
    """Restricted log-likelihood from the full covariance matrix."""
    x, y = dense(pdf, design), pdf.y.to_numpy()
    _, c, s = design.numeric["x"]
    z = np.column_stack([((pdf.x.to_numpy() - c) / s) ** d for d in random])
    same = pdf.unit.to_numpy()[:, None] == pdf.unit.to_numpy()[None, :]
    v = sigma2 * np.eye(len(y)) + same * (z @ theta_cov @ z.T)
    vi = np.linalg.inv(v)
    xvx = x.T @ vi @ x
    beta = np.linalg.solve(xvx, x.T @ vi @ y)
    r = y - x @ beta
    n, p = x.shape
    value = -0.5 * (
        np.linalg.slogdet(v)[1] + np.linalg.slogdet(xvx)[1] + r @ vi @ r + (n - p) * math.log(2 * math.pi)
    )
    effects = {
        u: theta_cov @ z[pdf.unit == u].T @ vi[np.ix_(pdf.unit == u, pdf.unit == u)] @ r[pdf.unit == u]
        for u in pdf.unit.unique()
    }
    return value, beta, effects


@pytest.mark.parametrize("random", [[0], [0, 1]])
def test_mixed_model_reaches_the_dense_optimum(spark, trial, random):
    pdf, df = trial
    fit = mixed.fit_mixed(
        df, "y", linear.crossed("x", "t", order=2), "unit", ["t"], {"x": 2},
        random=[{"x": d} if d else {} for d in random],
    )
    value, beta, effects = dense_reml(pdf, fit.design, random, fit.covariance, fit.sigma2)
    assert fit.loglik == pytest.approx(value, abs=1e-6)
    assert fit.beta == pytest.approx(beta, abs=1e-7)
    got = {r.unit: [r[f"u{i}"] for i in range(len(random))] for r in mixed.unit_effects(fit).collect()}
    for u, want in effects.items():
        assert got[u] == pytest.approx(want, abs=1e-6)
    for scale in (0.9, 1.1):  # no better point next to the optimum
        assert dense_reml(pdf, fit.design, random, fit.covariance * scale, fit.sigma2)[0] <= value + 1e-6
        assert dense_reml(pdf, fit.design, random, fit.covariance, fit.sigma2 * scale)[0] <= value + 1e-6
    if random == [0, 1]:
        grid = spark.createDataFrame([("a", "P", 20), ("new", "P", 20)], "unit string, t string, x int")
        rows = {r.unit: r for r in mixed.predict_mixed(fit, grid).collect()}
        assert rows["new"].unit_pred == pytest.approx(rows["new"].fixed_pred)
        assert rows["a"].unit_pred != pytest.approx(rows["a"].fixed_pred)
        small = mixed.fit_mixed(df, "y", linear.crossed("x", "t", order=2), "unit", ["t"], {"x": 2})
        lrt = mixed.likelihood_ratio(spark, small, fit).first()
        assert lrt.df == 2 and lrt.chi2 == pytest.approx(2 * (fit.loglik - small.loglik))
        assert {r.term for r in mixed.wald_tests(spark, fit).collect()} == {"x", "t", "x:t"}


def test_units_cut_by_record_batches(spark, trial):
    _, df = trial
    before = mixed.fit_mixed(df, "y", linear.crossed("x", "t"), "unit", ["t", "e"], {"x": 2})
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        after = mixed.fit_mixed(df, "y", linear.crossed("x", "t"), "unit", ["t", "e"], {"x": 2})
    finally:
        spark.conf.set(key, old)
    assert (after.n, after.n_units) == (before.n, before.n_units) == (583, 8)
    assert after.loglik == pytest.approx(before.loglik, abs=1e-8)


def test_moment_form_equals_likelihood_form_when_balanced(spark):
    rng = np.random.default_rng(3)
    rows = [
        (u, x, float(2 + x + b + rng.normal())) for u, b in enumerate(rng.normal(0, 2, 12)) for x in range(6)
    ]
    df = spark.createDataFrame(rows, "unit int, x int, y double").withColumn("p", F.lit("all"))
    moment = mixed.fit_mixed_moments(df, ["p"], "unit", "x", "y", degree=1)
    v = moment.variance.first()
    fit = mixed.fit_mixed(df, "y", [("x",)], "unit", numeric={"x": 1})
    # Both divide the within sum of squares differently: by N - units, by N - units - 1.
    sigma2 = v.sigma2 * (72 - 12) / (72 - 12 - 1)
    assert fit.sigma2 == pytest.approx(sigma2, rel=1e-3)
    tau2 = v.tau2 + (v.sigma2 - sigma2) / 6
    assert fit.covariance[0, 0] == pytest.approx(tau2, rel=1e-3)
    grid = mixed.predict_mixed_moments(moment, 0, 5, 6)
    assert grid.count() == 72


def test_nonlinear_recovers_a_known_curve(spark):
    def lactin(x):
        return np.exp(0.1 * x) - np.exp(0.1 * 33 - (33 - x) / 6.0) + 0.3

    rows = [(k, float(x), float(lactin(x)) * 1.0) for k in (1, 2) for x in range(10, 33, 2) for _ in range(2)]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    start = nonlinear.grouped_nonlinear(df, ["k"], "x", "y", "lactin2")
    fine = nonlinear.grouped_nonlinear(df, ["k"], "x", "y", "lactin2", steps=8)
    first = {r.k: r.sse for r in start.collect()}
    for r in fine.collect():
        assert r.status == "improved" and r.sse < 1e-6 < first[r.k]
        assert (r.p, r.tmax, r.dt, r.lam) == (
            pytest.approx(0.1, abs=1e-3), pytest.approx(33, abs=0.05),
            pytest.approx(6, abs=0.1), pytest.approx(0.3, abs=1e-2),
        )
    points = nonlinear.nonlinear_points(fine, ["k"], "lactin2", sequence_points(10, 32, 3))
    for r in points.collect():
        assert r.fit == pytest.approx(lactin(r.x), abs=1e-3)


@pytest.mark.parametrize("model", ["theta_logistic", "briere1"])
def test_scale_models_beat_their_lattice(spark, model):
    x = np.arange(13.0, 29.0)
    if model == "theta_logistic":
        y = 0.1 * x * (1 - (x / 31.3) ** 2.6)
    else:
        y = 2e-4 * x * (x - 4.3) * np.sqrt(33.7 - x)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)], "g int, x double, y double")
    lattice = nonlinear.grouped_nonlinear(df, ["g"], "x", "y", model).first()
    best = nonlinear.grouped_nonlinear(df, ["g"], "x", "y", model, steps=6).first()
    assert best.sse < 1e-8 < lattice.sse


def test_key_named_like_a_parameter_is_refused(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "k int, x double, y double")
    with pytest.raises(ValueError, match="rename"):
        nonlinear.grouped_nonlinear(df, ["k"], "x", "y", "theta_logistic")


def test_lattice_is_exhaustive(spark):
    rng = np.random.default_rng(5)
    x = np.repeat([13.0, 16, 20, 24, 28], 4)
    y = np.sin(x / 9) + rng.normal(0, 0.1, len(x))
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)], "k int, x double, y double")
    lattice = {"p": (0.02, 0.2, 4), "tmax": (28.0, 36.0, 3), "dt": (2.0, 8.0, 3)}
    got = nonlinear.grouped_nonlinear(df, ["k"], "x", "y", "lactin2", lattice).first()
    best = min(
        float((((y - g) - (y - g).mean()) ** 2).sum())
        for p in np.linspace(0.02, 0.2, 4) for tm in np.linspace(28, 36, 3) for d in np.linspace(2, 8, 3)
        for g in [np.exp(p * x) - np.exp(p * tm - (tm - x) / d)]
    )
    assert got.sse == pytest.approx(best) and got.n == 20


def test_model_families(spark, trial):
    _, df = trial
    rows = nonlinear.compare_models(df, ["t"], "x", "y", curves=("briere1",)).collect()
    assert len(rows) == 2 * 4
    for key in ("C", "P"):
        part = [r for r in rows if r.t == key]
        assert {r.best for r in part} == {min(part, key=lambda r: r.aic).model}


def test_smooth(spark, trial):
    pdf, df = trial
    knots, lambdas = [16.0, 20.0, 24.0], [0.1, 1.0, 10.0]
    for r in smooth.grouped_smooth(df, ["t"], "x", "y", knots, lambdas).collect():
        part = pdf[pdf.t == r.t]
        b = np.column_stack([np.ones(len(part)), part.x, *[np.maximum(part.x - k, 0) for k in knots]])
        best = None
        for lam in lambdas:
            inverse = np.linalg.inv(b.T @ b + lam * np.diag([0, 0, 1, 1, 1]))
            beta = inverse @ b.T @ part.y
            sse, edf = ((part.y - b @ beta) ** 2).sum(), np.trace(inverse @ b.T @ b)
            gcv = len(part) * sse / (len(part) - edf) ** 2
            if best is None or gcv < best[0]:
                best = (gcv, lam, edf, beta)
        assert (r.gcv, r["lambda"], r.edf) == (pytest.approx(best[0]), best[1], pytest.approx(best[2]))
        assert list(r.coefs) == pytest.approx(best[3], rel=1e-6)
    _, variance, offsets = smooth.smooth_with_offsets(df, ["t"], "unit", "x", "y", knots)
    assert variance.first().tau2 > 0 and offsets.count() == 8


def test_local_regression(trial):
    pdf, df = trial
    out = smooth.local_regression(df, ["t"], "x", "y", 1.5, sequence_points(13, 28, 5))
    for r in out.collect():
        part = pdf[pdf.t == r.t]
        d = part.x.to_numpy() - r.x
        w = np.sqrt((1 - (np.abs(d) / (1.5 * np.abs(d).max())) ** 3) ** 3)
        b = np.column_stack([np.ones(len(d)), d, d * d])
        want = np.linalg.lstsq(b * w[:, None], part.y * w, rcond=None)[0][0]
        assert r.fit == pytest.approx(want, abs=1e-7)
    with pytest.raises(ValueError):
        smooth.local_regression(df, ["t"], "x", "y", 0.5, sequence_points(13, 28, 5))


def curve(spark, fn):
    return spark.createDataFrame([("c", float(x), float(fn(x))) for x in range(11)], "k string, x double, fit double")


def test_curve_traits(spark):
    hill = curve(spark, lambda x: 9 - (x - 6) ** 2)
    peak = curves.curve_peak(hill, ["k"]).first()
    assert (peak.topt, peak.popt, peak.n_ties, peak.at_edge) == (6.0, 9.0, 1, False)
    flat = curves.curve_peak(curve(spark, lambda x: 1.0), ["k"]).first()
    assert (flat.topt, flat.n_ties, flat.at_edge) == (0.0, 11, True)
    ys = [9 - (x - 6) ** 2 for x in range(11)]
    area = sum((a + b) / 2 for a, b in zip(ys, ys[1:], strict=False))
    for segments in (0, 3):
        assert curves.curve_area(hill, ["k"], segments=segments).first().auc == pytest.approx(area)
    base = curves.curve_area(hill, ["k"], baseline="min").first().auc
    assert base == pytest.approx(area - 10 * min(ys))
    twice = curves.curve_area(hill.union(hill), ["k"]).first().auc
    assert twice == pytest.approx(area)
    limits = curves.critical_limits(hill, ["k"], 0.0).first()
    assert (limits.crit_low, limits.crit_high) == (3.0, 9.0)
    traits = curves.four_traits(hill, ["k"], {0.0: "lo", 10.0: "hi"}).first()
    assert (traits.lo, traits.hi, traits.topt, traits.popt) == (-27.0, -7.0, 6.0, 9.0)
    assert {r.metric for r in curves.shape_rows(hill, ["k"], 0, 10).collect()} == {"Opt", "Min", "Max"}


def test_turning_points(spark):
    assert curves.turning_point(curve(spark, lambda x: 9 - (x - 6) ** 2), ["k"]).first().turn_x == 6.0
    assert curves.turning_point(curve(spark, lambda x: x * 2), ["k"]).first().turn_x == 10.0
    assert curves.turning_point(curve(spark, lambda x: -x * 2), ["k"]).first().turn_x == 0.0
    cubic = fitting.grouped_poly(curve(spark, lambda x: -((x - 3) ** 3) + 12 * (x - 3)), ["k"], "x", "fit", 3)
    at = curves.polynomial_turning_points(cubic, ["k"], 3).first()
    assert (at.turn_x, at.turn_y) == (pytest.approx(5.0, abs=1e-6), pytest.approx(16.0, abs=1e-5))


def test_edge_exclusion(spark):
    rising = curve(spark, lambda x: x).withColumn("k", F.lit("rising"))
    both = curve(spark, lambda x: 9 - (x - 6) ** 2).union(rising)
    edges = curves.edge_optima(both, ["k"])
    assert [r.k for r in edges.collect()] == ["rising"]
    assert {r.k for r in curves.exclude_curves(both, edges, ["k"]).collect()} == {"c"}


def test_null_keys_keep_their_curves(spark):
    humped = curve(spark, lambda x: 9 - (x - 6) ** 2)
    rising = curve(spark, lambda x: x).withColumn("k", F.lit(None).cast("string"))
    both = humped.union(rising)
    traits = {r.k: (r.lo, r.topt, r.popt) for r in curves.four_traits(both, ["k"], {0.0: "lo"}).collect()}
    assert traits == {"c": (-27.0, 6.0, 9.0), None: (0.0, 10.0, 10.0)}
    edges = curves.edge_optima(both, ["k"])
    assert {r.k for r in curves.exclude_curves(both, edges, ["k"]).collect()} == {"c"}
    lines = plotting.smooth_lines(both, ["k"], "x", "fit", 2, 5)
    assert {(r.k, r["count"]) for r in lines.groupBy("k").count().collect()} == {("c", 5), (None, 5)}


def test_vertices_of_random_curves_in_every_cell(spark, trial):
    _, df = trial
    fit = mixed.fit_mixed(
        df, "y", linear.crossed("x", "t", "e", order=2), "unit", ["t", "e"], {"x": 2}, random=[{}, {"x": 1}]
    )
    rows = mixed.cell_vertices(fit, "x").collect()
    cells = [(t, e) for t in fit.design.factors["t"] for e in fit.design.factors["e"]]
    units = {r.unit for r in rows}
    assert len(rows) == len(units) * len(cells) == fit.n_units * len(cells)
    grid = spark.createDataFrame([(u, t, e, x) for u in units for t, e in cells for x in (14, 27)], "unit string, t string, e string, x int")
    curve = {(r.unit, r.t, r.e): (r.a, r.h, r.k) for r in rows}
    for r in mixed.predict_mixed(fit, grid.select("unit", "t", F.col("e").cast(df.schema["e"].dataType).alias("e"), "x")).collect():
        a, h, k = next(v for key, v in curve.items() if tuple(map(str, key)) == (r.unit, r.t, str(r.e)))
        assert a * (r.x - h) ** 2 + k == pytest.approx(r.unit_pred, rel=1e-8)
    t, e = cells[-1]
    one = {r.unit: (r.a, r.h, r.k) for r in mixed.unit_vertices(fit, "x", {"t": t, "e": e}).collect()}
    assert one == {u: curve[u, t, e] for u in units}
    values = {r.component: r.value for r in mixed.variance_table(spark, fit).collect()}
    assert values["converged"] == float(fit.converged)
