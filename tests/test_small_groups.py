"""Fits inside tasks against the same fits by aggregations, and the lattice's ties."""

import numpy as np
import pytest

from curvewise.operators import nonlinear

RANGES = {
    "lactin2": {"p": (0.02, 0.3, 8), "tmax": (24.0, 40.0, 5), "dt": (1.0, 10.0, 4)},
    "theta_logistic": {"k": (20.0, 35.0, 6), "theta": (0.5, 5.0, 4)},
    "briere2": {"t0": (-5.0, 12.0, 6), "tm": (28.5, 45.0, 5), "m": (1.0, 6.0, 3)},
}


@pytest.fixture(scope="module")
def groups(spark):
    """Three noisy curves, one flat group, one of two x, one with x = 0 only, one with a null key."""
    rng = np.random.default_rng(5)
    x = np.repeat(np.arange(12.0, 31.0, 1.5), 4)
    clean = np.exp(0.11 * x) - np.exp(0.11 * 33 - (33 - x) / 6)
    rows = [(str(g), a, b) for g in range(3) for a, b in zip(x, clean * (g + 1) + rng.normal(0, 0.1, len(x)), strict=True)]
    rows += [("flat", a, 2.0) for a in x] + [("few", 13.0, 1.0), ("few", 14.0, 2.0), ("zero", 0.0, 1.0), ("zero", 0.0, 2.0)]
    rows += [(None, a, b) for a, b in zip(x, clean, strict=True)]
    return spark.createDataFrame([(g, float(a), float(b)) for g, a, b in rows], "key string, x double, y double")


@pytest.mark.parametrize("local", [0, 10], ids=["aggregations", "both"])
@pytest.mark.parametrize("steps", [0, 2])
def test_both_ways_agree(spark, groups, monkeypatch, local, steps):
    def all_fits():
        sums = nonlinear.stored(nonlinear.per_x_sums(groups, ["key"], "x", "y"))
        found = nonlinear.fit_models(sums, ["key"], RANGES, steps)
        return {(m, r.key): r.asDict() for m, fit in found.items() for r in fit.collect()}

    mine = all_fits()
    monkeypatch.setattr(nonlinear, "LOCAL_X", local)
    wide = all_fits()
    assert set(mine) == set(wide) and len(mine) == 7 * len(RANGES)
    for at, a in mine.items():
        b = wide[at]
        assert set(a) == set(b)
        if at[1] in ("0", "1", "2"):
            assert a["sse"] == pytest.approx(b["sse"], rel=1e-6)
            assert a.get("converged") == b.get("converged") and a.get("steps") == b.get("steps")
        elif a["sse"] is None or b["sse"] is None:
            assert a["sse"] == b["sse"]
        else:
            assert a["sse"] == pytest.approx(b["sse"], abs=1e-3)


def test_a_refined_fit_shuffles_no_rows_in_its_rounds(spark, groups, monkeypatch):
    """Small groups are fitted in one pass: no round writes a state."""
    written = []
    keep = nonlinear.stored
    monkeypatch.setattr(nonlinear, "stored", lambda df: written.append(1) or keep(df))
    fit = nonlinear.grouped_nonlinear(groups, ["key"], "x", "y", "lactin2", RANGES["lactin2"], steps=30)
    assert fit.count() == 7
    assert len(written) == 3  # per-x sums, keys of large groups, fits


def test_equal_lattice_points_go_to_the_smallest(spark):
    """With p * dt = 1 the curve is 0 for every tmax, so all points are equal."""
    rows = [(g, float(x), float(np.sin(g * 31 + x * 7))) for g in range(40) for x in range(11)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    lattice = {"p": (0.25, 0.25, 1), "tmax": (11.0, 16.0, 6), "dt": (4.0, 4.0, 1)}
    assert {r.tmax for r in nonlinear.grouped_nonlinear(df, ["g"], "x", "y", "lactin2", lattice).collect()} == {11.0}


@pytest.mark.parametrize("local", [256, 0], ids=["tasks", "aggregations"])
def test_runaway_curves_have_a_true_residual_sum(spark, monkeypatch, local):
    """Without a curve in the data some fits run to huge values, whose sums of squares once came out far below 0."""
    monkeypatch.setattr(nonlinear, "LOCAL_X", local)
    rng = np.random.default_rng(1)
    rows = [(g, float(x), float(10 + rng.normal())) for g in range(600) for x in np.repeat(np.arange(11), 2)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    lattice = {"p": (0.05, 0.25, 5), "tmax": (11.0, 16.0, 6), "dt": (1.0, 4.0, 4)}
    fits = nonlinear.grouped_nonlinear(df, ["g"], "x", "y", "lactin2", lattice, steps=4).collect()
    assert len(fits) == 600 and all(r.sse > 0 for r in fits)
