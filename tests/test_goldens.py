"""Recompute a published cell summary from the life table and the individuals.

Set OBSERVATION_FOLDER to a folder with the three CSV tables; they are told apart by
their columns. The log-likelihoods and sums of squares are fixed values computed once
with dense numpy from the same tables.
"""

import glob
import os

import pytest
from pyspark.sql import functions as F

from curvewise.operators import curves, fitting, linear, mixed, ordering, summarising, traits
from curvewise.operators.joining import natural_join, sequence_points
from curvewise.sources import read_observations

FOLDER = os.environ.get("OBSERVATION_FOLDER", "")
CELL = ["Clone", "Temperature", "Treatment", "Experiment"]
CURVE = ["Clone", "Treatment", "Experiment"]

pytestmark = pytest.mark.skipif(not FOLDER, reason="OBSERVATION_FOLDER is not set")


@pytest.fixture(scope="module")
def data(spark):
    found = {}
    for path in glob.glob(os.path.join(FOLDER, "*.csv")):
        df = read_observations(spark, path)
        if "Survival" in df.columns:
            found["life"] = df
        elif "Ro_B2" in df.columns:
            found["summary"] = df
        elif "Growth" in df.columns:
            found["individuals"] = df
    return found


def ro(data, stages):
    return traits.net_reproduction(data["life"], CELL, "Stage", stages, "Survival", "Mean_Rep")


def test_shapes(data):
    assert data["life"].count() == 706 and data["individuals"].count() == 601
    assert data["summary"].count() == 179


@pytest.mark.parametrize(
    "column, stages, agree",
    [("Ro_B1", ["B1"], 179), ("Ro_B2", ["B1", "B2"], 179), ("Ro_B3", ["B1", "B2", "B3", "B4", "B5"], 178)],
)
def test_net_reproduction_column(data, column, stages, agree):
    both = natural_join(data["summary"].select(*CELL, column), ro(data, stages), "inner")
    assert both.where(F.abs(F.col(column) - F.col("ro")) <= 0.02).count() == agree


@pytest.mark.parametrize(
    "y, mean, se, n_mean, n_se",
    [("Growth", "MeanSGrowth", "seSGrowth", 175, 161), ("maxInduction", "meanMaxInd", "seMaxInd", 172, 171)],
)
def test_cell_means_and_errors(data, y, mean, se, n_mean, n_se):
    cells = summarising.mean_se(data["individuals"], CELL, y).withColumnsRenamed({"mean": "m", "se": "s"})
    both = natural_join(data["summary"].select(*CELL, mean, se), cells, "inner")
    assert both.where(F.abs(F.col(mean) - F.col("m")) < 1e-6).count() == n_mean
    assert both.where(F.abs(F.col(se) - F.col("s")) < 1e-6).count() == n_se


def test_vertices_and_areas(data):
    v = fitting.grouped_vertex(data["individuals"], CURVE, "Temperature", "Growth")
    r = v.where("Clone = 'C14' AND Treatment = 'Control' AND Experiment = 'Acclim'").first()
    assert (r.n, r.h, r.k) == (12, pytest.approx(22.1625416, abs=1e-6), pytest.approx(0.1998453, abs=1e-7))
    assert v.where("convex").count() == 6
    coefs = fitting.grouped_poly(data["individuals"], CURVE, "Temperature", "Growth")
    points = fitting.curve_points(coefs, CURVE, sequence_points(13, 28, 100))
    assert curves.curve_peak(points, CURVE).where("at_edge").count() == 15
    areas = summarising.mean_se(curves.curve_area(points, CURVE), ["Treatment", "Experiment"], "auc")
    got = {(r.Treatment, r.Experiment): (r.mean, r.se) for r in areas.collect()}
    assert got[("Control", "Acclim")] == (pytest.approx(2.366686, abs=1e-6), pytest.approx(0.122011, abs=1e-6))
    assert got[("Predator", "Acute")] == (pytest.approx(2.138168, abs=1e-6), pytest.approx(0.156254, abs=1e-6))


def test_marginal_sums_of_squares(spark, data):
    fit = linear.fit_linear(
        data["individuals"], "Growth", linear.crossed("Treatment", "Experiment"), ["Treatment", "Experiment"]
    )
    ss = {r.term: r.sum_sq for r in linear.anova_marginal(spark, fit).collect()}
    assert ss["Treatment"] == pytest.approx(4.500201e-05, rel=1e-6)
    assert ss["Experiment"] == pytest.approx(7.596275e-03, rel=1e-6)
    assert ss["Treatment:Experiment"] == pytest.approx(1.160984e-03, rel=1e-6)


def test_restricted_likelihoods(spark, data):
    def fit(random):
        return mixed.fit_mixed(
            ro(data, ["B1", "B2"]), "ro", linear.crossed("Temperature", "Treatment", "Experiment"), "Clone",
            ["Treatment", "Experiment"], {"Temperature": (2, 20.2, 5.0)}, random=random,
        )

    small = fit(({},))
    large = fit(({}, {"Temperature": 1}, {"Temperature": 2}))
    assert small.loglik == pytest.approx(-632.8303, abs=1e-4)
    assert (small.sigma2, small.covariance[0, 0]) == (
        pytest.approx(34.93742, abs=1e-3), pytest.approx(10.02327, abs=1e-3),
    )
    assert large.loglik == pytest.approx(-627.0751, abs=1e-4) and large.singular
    assert mixed.likelihood_ratio(spark, small, large).first().chi2 == pytest.approx(11.510, abs=1e-3)


def test_quantiles_agree_with_the_builtin(data):
    df = data["individuals"]
    ours = {
        (r.Clone, r.prob): r.quantile
        for r in ordering.exact_quantiles(df, ["Clone"], "Growth", [0.25, 0.5], max_group=None).collect()
    }
    for r in df.groupBy("Clone").agg(F.percentile("Growth", F.array(F.lit(0.25), F.lit(0.5))).alias("q")).collect():
        assert ours[(r.Clone, 0.25)] == pytest.approx(r.q[0]) and ours[(r.Clone, 0.5)] == pytest.approx(r.q[1])
