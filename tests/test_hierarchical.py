"""Joint smooths against one dense penalised system of all coefficients."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvewise.operators import hierarchical
from curvewise.operators.joining import sequence_points

KNOTS = [16.0, 20.0, 24.0]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    rows = []
    for g in range(12):
        bump = 0.4 * (g % 3)
        for t in rng.uniform(13, 28, rng.integers(3, 25)):
            y = 5 + np.sin(t / 4) + 0.1 * g + bump * np.cos(t * (1 + g % 2)) + rng.normal(0, 0.2)
            rows.append((None if g == 7 else f"g{g}", float(t), float(y)))
    rows += [("g1", None, 3.0), ("g2", 15.0, None), ("single", 20.0, 6.0)]
    return pd.DataFrame(rows, columns=["k", "x", "y"]), spark.createDataFrame(rows, "k string, x double, y double").repartition(4)


class Dense:
    """All coefficients in one system, penalties by group."""

    def __init__(self, pdf):
        pdf = pdf.dropna(subset=["x", "y"]).copy()
        pdf["k"] = pdf.k.astype(object).where(pdf.k.notna(), "none")
        self.groups, self.n = sorted(pdf.k.unique()), len(pdf)
        x, self.y = pdf.x.to_numpy(), pdf.y.to_numpy() - pdf.y.mean()
        self.level, self.centre, self.spread = pdf.y.mean(), x.mean(), x.std()
        b = self.basis(x)
        self.p = b.shape[1]
        self.design = np.hstack([b, *[b * (pdf.k == g).to_numpy()[:, None] for g in self.groups]])
        self.sizes = {g: int((pdf.k == g).sum()) for g in self.groups}

    def basis(self, x):
        return np.column_stack([np.ones(len(x)), (x - self.centre) / self.spread, *[np.maximum(x - k, 0) / self.spread for k in KNOTS]])

    def fit(self, common, group, offset):
        diag = [0.0, 0.0] + [common * self.n] * len(KNOTS)
        for g in self.groups:
            diag += [offset] + [group[g] * self.sizes[g]] * (self.p - 1)
        a = self.design.T @ self.design
        inverse = np.linalg.pinv(a + np.diag(diag), hermitian=True, rcond=1e-13)
        beta = inverse @ self.design.T @ self.y
        return beta, float(((self.y - self.design @ beta) ** 2).sum()), float(np.trace(inverse @ a))


def test_shared_penalties_as_one_dense_system(data):
    pdf, df = data
    dense = Dense(pdf)
    lattice = {"common": (0.001, 0.1), "group": (0.01, 1.0), "offset": (1.0, 10.0)}
    fit = hierarchical.joint_smooth(df, ["k"], "x", "y", KNOTS, **lattice)
    scores = {}
    for c in lattice["common"]:
        for a in lattice["group"]:
            for b in lattice["offset"]:
                beta, sse, edf = dense.fit(c, dict.fromkeys(dense.groups, a), b)
                scores[c, a, b] = (dense.n * sse / (dense.n - edf) ** 2, beta, sse, edf)
    best = min(scores, key=lambda k: scores[k][0])
    assert (fit.penalties["common"], fit.penalties["group"], fit.penalties["offset"]) == best
    gcv, beta, sse, edf = scores[best]
    assert (fit.n, fit.sse, fit.edf, fit.gcv) == (dense.n, pytest.approx(sse, rel=1e-8), pytest.approx(edf, rel=1e-8), pytest.approx(gcv, rel=1e-8))
    assert list(fit.coefs) == pytest.approx(beta[: dense.p], abs=1e-7)
    rows = {r.k or "none": r for r in fit.groups.collect()}
    assert set(rows) == set(dense.groups)
    for i, g in enumerate(dense.groups, 1):
        assert list(rows[g].coefs) == pytest.approx(beta[i * dense.p : (i + 1) * dense.p], abs=1e-7)
        assert rows[g].n == dense.sizes[g]
    points = hierarchical.joint_points(fit, sequence_points(13, 28, 7)).collect()
    assert len(points) == 7 * len(dense.groups)
    for r in points:
        i = dense.groups.index(r.k or "none") + 1
        b = dense.basis(np.array([r.x]))[0]
        assert r.common == pytest.approx(dense.level + b @ beta[: dense.p], abs=1e-6)
        assert r.fit == pytest.approx(dense.level + b @ (beta[: dense.p] + beta[i * dense.p : (i + 1) * dense.p]), abs=1e-6)


def test_separate_penalties_stand_still_and_match_the_dense_system(data):
    pdf, df = data
    dense = Dense(pdf)
    fit = hierarchical.joint_smooth(df, ["k"], "x", "y", KNOTS, "separate")
    assert fit.converged and 1 < fit.steps < 30
    rows = {r.k or "none": r for r in fit.groups.collect()}
    own = {g: rows[g]["group"] for g in dense.groups}
    assert len(set(own.values())) > 1
    beta, sse, edf = dense.fit(fit.penalties["common"], own, fit.penalties["offset"])
    assert (fit.sse, fit.edf) == (pytest.approx(sse, rel=1e-6), pytest.approx(edf, rel=1e-6))
    assert list(fit.coefs) == pytest.approx(beta[: dense.p], abs=1e-5)


def test_penalties_do_not_depend_on_the_amount_of_data(data):
    _, df = data
    few = {"common": (0.01,), "group": (0.1,), "offset": (1e-9,)}
    once = hierarchical.joint_smooth(df, ["k"], "x", "y", KNOTS, **few)
    often = hierarchical.joint_smooth(df.union(df).union(df), ["k"], "x", "y", KNOTS, **few)
    assert list(often.coefs) == pytest.approx(list(once.coefs), abs=1e-5) and often.sse == pytest.approx(3 * once.sse, rel=1e-5)


def test_comparison_and_refusals(spark, data):
    _, df = data
    rows = {r.wiggliness: r for r in hierarchical.compare_wiggliness(df, ["k"], "x", "y", KNOTS).collect()}
    assert set(rows) == {"shared", "separate"} and len({r.best for r in rows.values()}) == 1
    assert rows["shared"].best == min(rows.values(), key=lambda r: r.gcv).wiggliness
    with pytest.raises(ValueError, match="no rows"):
        hierarchical.joint_smooth(df.where(F.lit(False)), ["k"], "x", "y", KNOTS)
    with pytest.raises(ValueError, match="shared"):
        hierarchical.joint_smooth(df, ["k"], "x", "y", KNOTS, "other")
