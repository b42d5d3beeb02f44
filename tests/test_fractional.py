"""Fractional polynomials per group do not depend on where x lies."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvewise.operators import fitting


def dense(x, y, shift):
    """Fitted values and sse by QR in long arithmetic of the centred columns."""
    c = x.mean()
    t = (x - c) / (c + shift)
    cube = np.array([math.fsum((-1) ** k * v ** (k + 3) / (k + 3) for k in range(60)) if abs(v) < 0.3 else math.log1p(v) - v + v * v / 2 for v in t])
    design = np.column_stack([np.ones_like(x), t, t * t, cube])
    design /= np.abs(design).max(axis=0)
    q, _ = np.linalg.qr(design)
    fit = q @ (q.T @ y)
    return fit, ((y - fit) ** 2).sum()


@pytest.mark.parametrize("start", [0.0, 13.0, 286.15, 2000.0, 738_000.0])
def test_values_equal_dense_fit(spark, start):
    rng = np.random.default_rng(5)
    x = start + np.repeat(np.arange(16.0), 4)
    y = 2 + np.sin((x - start) / 4) + rng.normal(0, 0.1, len(x))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double").withColumn("k", F.lit("a"))
    want, sse = dense(x, y, 1.0)
    coefs = fitting.grouped_fractional(df, ["k"], "x", "y", 1.0, centred=True)
    got = df.join(coefs, "k").withColumn("fit", fitting.fractional_fitted(F.col("x"), 1.0, centred=True)).orderBy("x", "y").collect()
    order = np.lexsort((y, x))
    assert [r.fit for r in got] == pytest.approx(list(want[order]), abs=1e-8)
    assert got[0].sse == pytest.approx(sse, rel=1e-8)


def test_raw_coefficients_short_groups_and_rows_outside(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(np.arange(1.0, 9.0), 3)
    y = rng.normal(0, 1, len(x))
    rows = [("a", float(a), float(b)) for a, b in zip(x, y, strict=True)]
    rows += [("a", -1.0, 50.0), ("a", None, 1.0), ("a", 3.0, None)]
    rows += [("three", float(i % 3), float(i)) for i in range(9)] + [("one", 4.0, 1.0), ("same", 4.0, 1.0), ("same", 4.0, 3.0), ("none", -5.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    found = {r.k: r for r in fitting.grouped_fractional(df, ["k"], "x", "y", 0.0).collect()}
    design = np.column_stack([np.ones_like(x), x, np.log(x), x * x])
    want, sse, *_ = np.linalg.lstsq(design, y, rcond=None)
    r = found["a"]
    assert [r.b0, r.b1, r.b2, r.b3] == pytest.approx(list(want), rel=1e-7)
    assert r.n == len(x) and r.sse == pytest.approx(float(sse[0]), rel=1e-9)
    assert "none" not in found and found["one"].b1 is None
    assert found["three"].b1 is None and found["same"].b1 is None and found["same"].sst == pytest.approx(2.0)
    assert fitting.grouped_fractional(df.limit(0), ["k"], "x", "y").count() == 0
