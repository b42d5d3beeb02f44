"""Order-based operators against brute force, on groups that are very uneven."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvewise.operators import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds two thirds of the rows; many equal values; a null key."""
    rng = np.random.default_rng(7)
    n = 6000
    k = np.where(rng.random(n) < 0.66, "hot", rng.choice(["a", "b", "c"], n)).astype(object)
    k[:40] = None
    y = np.where(rng.random(n) < 0.3, 5.0, np.round(rng.gamma(2.0, 3.0, n), 3))
    pdf = pd.DataFrame({"k": k, "y": y, "i": np.arange(n)})
    df = spark.createDataFrame(pdf, "k string, y double, i long").cache()
    return pdf.assign(g=[v or "-" for v in k]), df


@pytest.mark.parametrize("max_group", [1_000_000, 500, None])
def test_quantiles(skewed, max_group):
    pdf, df = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {
        (r.k, r.prob): r.quantile
        for r in ordering.exact_quantiles(df, ["k"], "y", probs, max_group).collect()
    }
    groups = list(pdf.groupby("g"))
    assert len(got) == len(groups) * len(probs)
    for key, part in groups:
        name = None if key == "-" else key
        for p in probs:
            assert got[(name, p)] == pytest.approx(np.quantile(part.y, p), abs=1e-12)


def test_top_n_keeps_ties(skewed):
    pdf, df = skewed
    rank = pdf.groupby("g").y.rank(method="min", ascending=False)
    got = {r.i for r in ordering.top_n(df, ["k"], "y", 4).collect()}
    assert got == set(pdf.i[rank <= 4])


def test_argmax_and_group_values(skewed):
    pdf, df = skewed
    best = pdf.groupby("g").y.transform("max")
    for bounded in (False, True):
        got = {r.i for r in ordering.argmax_rows(df, ["k"], "y", bounded).collect()}
        assert got == set(pdf.i[pdf.y == best])


@pytest.mark.parametrize("segments", [0, 2, 7])
def test_adjacent_rows_in_segments(skewed, segments):
    pdf, df = skewed
    got = {
        r.i: r.diff for r in ordering.differences(df, ["k"], "i", "y", segments).collect()
    }
    want = pdf.sort_values("i").groupby("g").y.diff()
    for i, w in zip(pdf.i, want, strict=True):
        assert got[i] is None if np.isnan(w) else got[i] == pytest.approx(w)


def test_first_last_and_nearest(skewed):
    pdf, df = skewed
    rows = ordering.first_last(df, ["k"], ["i"], ["y"]).where("k = 'hot'").limit(3).collect()
    hot = pdf[pdf.k == "hot"]
    assert all(r.first_y == hot.y.iloc[0] and r.last_y == hot.y.iloc[-1] for r in rows)
    near = {r.k: r.i for r in ordering.nearest_row(df, ["k"], "y", 4.99, ["i"]).collect()}
    d = hot.assign(d=(hot.y - 4.99).abs()).sort_values(["d", "i"])
    assert near["hot"] == d.i.iloc[0]


def test_box(skewed):
    pdf, df = skewed
    got = {r.k: r for r in ordering.box_stats(df, ["k"], "y").collect()}
    hot = pdf[pdf.k == "hot"].y
    q1, q3 = np.quantile(hot, [0.25, 0.75])
    inside = hot[(hot >= q1 - 1.5 * (q3 - q1)) & (hot <= q3 + 1.5 * (q3 - q1))]
    r = got["hot"]
    assert (r.n, r.n_outliers) == (len(hot), len(hot) - len(inside))
    assert (r.whisker_low, r.whisker_high) == (inside.min(), inside.max())


def test_segments_follow_the_order(skewed):
    _, df = skewed
    cut = ordering.segment(df, ["k"], "y", [0.2, 0.5, 0.9])
    spans = cut.groupBy("k", "seg").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).collect()
    for key in {r.k for r in spans}:
        ordered = sorted((r.seg, r.lo, r.hi) for r in spans if r.k == key)
        assert all(a[2] < b[1] for a, b in zip(ordered, ordered[1:], strict=False))
