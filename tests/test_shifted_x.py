"""Polynomials per group do not depend on where x lies, and no curve vanishes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvewise.operators import curves, fitting

STARTS = {"celsius": 13.0, "kelvin": 286.15, "year": 2000.0, "day": 738_000.0, None: 5.0}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(np.arange(16.0), 5)
    y = 2 + 0.4 * x - 0.05 * x**2 + 0.001 * x**3 + rng.normal(0, 0.1, len(x))
    data = [(k, float(start + a), float(b)) for k, start in STARTS.items() for a, b in zip(x, y, strict=True)]
    return spark.createDataFrame(data, "k string, x double, y double"), x, y


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_fit_follows_the_shift(rows, degree):
    df, x, y = rows
    want = np.polynomial.polynomial.polyfit(x - x.mean(), y, degree)
    sse = ((y - np.polynomial.polynomial.polyval(x - x.mean(), want)) ** 2).sum()
    found = fitting.grouped_poly(df, ["k"], "x", "y", degree, centred=True).collect()
    assert {r.k for r in found} == set(STARTS)
    for r in found:
        assert r.center == pytest.approx(STARTS[r.k] + x.mean())
        assert [r[f"b{i}"] for i in range(degree + 1)] == pytest.approx(list(want), rel=1e-6)
        assert r.sse == pytest.approx(sse, rel=1e-6)


def test_raw_coefficients_on_kelvin_and_years(rows):
    df, x, y = rows
    want = np.polynomial.polynomial.polyval(x[::5] - x.mean(), np.polynomial.polynomial.polyfit(x - x.mean(), y, 3))
    for r in fitting.grouped_poly(df.where("k in ('celsius', 'kelvin', 'year')"), ["k"], "x", "y", 3).collect():
        at = STARTS[r.k] + x[::5]
        assert ((r.b3 * at + r.b2) * at + r.b1) * at + r.b0 == pytest.approx(want, abs=1e-6)


def test_points_residuals_and_vertex(rows):
    df, x, y = rows
    coefs = fitting.grouped_poly(df, ["k"], "x", "y", 2, centred=True)
    resid = fitting.augment(df, coefs, ["k"], "x", "y").groupBy("k").agg(F.sum(F.col("resid") ** 2).alias("s"), F.count("*").alias("n"))
    line = np.polyfit(x, y, 2)
    sse = ((y - np.polyval(line, x)) ** 2).sum()
    assert all(r.s == pytest.approx(sse, rel=1e-6) and r.n == len(x) for r in resid.collect())
    for r in fitting.grouped_vertex(df.withColumnRenamed("k", "name"), ["name"], "x", "y").collect():
        assert r.h - STARTS[r.name] == pytest.approx(-line[1] / (2 * line[0]), rel=1e-6)
    points = fitting.curve_points(coefs, ["k"], F.array(*[F.lit(v) for v in (5.0, 286.15, 2007.0, 738_007.0)]))
    assert points.where(F.isnan("fit")).count() == 0
    assert points.count() == 4 * len(STARTS)


def test_aic_is_the_same_everywhere(rows):
    df, _, _ = rows
    found = fitting.polynomial_aics(df, ["k"], "x", "y").collect()
    assert len(found) == len(STARTS)
    for c in ("aic_linear", "aic_quadratic", "aic_cubic"):
        assert [r[c] for r in found] == pytest.approx([found[0][c]] * len(STARTS), rel=1e-6)


def test_no_keys_and_too_few_x(spark, rows):
    df, x, y = rows
    one = fitting.grouped_poly(df.where("k = 'year'"), [], "x", "y", 2, centred=True).first()
    assert one.b2 == pytest.approx(np.polyfit(x, y, 2)[0], rel=1e-6)
    few = spark.createDataFrame([("a", 2001.0, 1.0), ("a", 2002.0, 2.0), ("b", 3.0, 1.0), ("c", None, 1.0)], "k string, x double, y double")
    found = {r.k: r for r in fitting.grouped_poly(few, ["k"], "x", "y", 2).collect()}
    assert set(found) == {"a", "b"}
    assert found["a"].b2 is None and found["b"].b1 is None


def test_peak_and_area_in_one_pass(rows):
    df, _, _ = rows
    coefs = fitting.grouped_poly(df, ["k"], "x", "y", 2, centred=True)
    points = fitting.curve_points(coefs, ["k"], F.sequence(F.lit(0), F.lit(20)))
    both = {r.k: r for r in curves.peak_and_area(points, ["k"], baseline="min").collect()}
    peak = {r.k: r for r in curves.curve_peak(points, ["k"]).collect()}
    area = {r.k: r.auc for r in curves.curve_area(points, ["k"], baseline="min").collect()}
    assert set(both) == set(STARTS)
    for k, r in both.items():
        assert (r.topt, r.popt) == (peak[k].topt, peak[k].popt)
        assert r.auc == pytest.approx(area[k])
