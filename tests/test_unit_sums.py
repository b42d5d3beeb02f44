"""Sums of the restricted likelihood of many candidates at once, against each unit's dense covariance."""

import numpy as np
import pandas as pd
import pytest

from curvewise.operators import mixed


@pytest.mark.parametrize("q", [1, 2, 3])
def test_sums_of_all_candidates_agree_with_dense_units(spark, q):
    rng = np.random.default_rng(q)
    p, units, thetas = 4, 7, rng.normal(size=(5, q * (q + 1) // 2))
    thetas[0] = 0.0
    rows, want = [], np.zeros((5, 2 + p * p + p))
    for u in range(units):
        x, y = rng.normal(size=(9, p)), rng.normal(size=9)
        z = x[:, :q]
        rows.append((u, *[list(map(float, v.ravel())) for v in (x.T @ x, x.T @ y)], float(y @ y), *[list(map(float, v.ravel())) for v in (z.T @ z, z.T @ x, z.T @ y)]))
        for c, theta in enumerate(thetas):
            lam = mixed._factor(theta, q)
            v = np.eye(9) + z @ lam @ lam.T @ z.T
            vi = np.linalg.inv(v)
            want[c] += np.concatenate([[np.linalg.slogdet(v)[1]], (x.T @ vi @ x).ravel(), x.T @ vi @ y, [y @ vi @ y]])
    a = "array<double>"
    df = spark.createDataFrame(rows, f"unit int, xx {a}, xy {a}, yy double, zz {a}, zx {a}, zy {a}")
    assert mixed._sums(df.repartition(3), thetas, p, q) == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_a_unit_costs_one_product_for_all_candidates():
    """The dense terms of a unit are not made anew for each candidate, so many candidates cost little more."""
    rng = np.random.default_rng(0)
    z = rng.normal(size=(50, 8, 3))
    zz = z.transpose(0, 2, 1) @ z
    lams = np.stack([mixed._factor(t, 3) for t in rng.normal(size=(35, 6))])
    logdet, weights = mixed._unit_weights(zz, lams)
    assert logdet.shape == (35, 50) and weights.shape == (6, 35, 50)
    batch = (*[np.asarray(pd.NA)] * 4, rng.normal(size=(50, 3, 12)), rng.normal(size=(50, 3)))
    assert mixed._unit_features(batch, 3).shape == (6, 50, 91)
