"""Curve-derived traits (V) and tables behind figures (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvewise.functions.columns import standard_error
from curvewise.operators import curves, plotting
from curvewise.operators.fitting import curve_points, grouped_poly
from curvewise.operators.joining import sequence_points
from curvewise.operators.summarising import mean_se
from curvewise.plans.base import (
    CURVE,
    CURVE_SQL,
    HIGH,
    LOW,
    OBS,
    POINTS,
    PTS,
    design_sql,
    obs,
    quadratic_sql,
    query,
    rounded,
)
from curvewise.plans.model_queries import CUBIC
from curvewise.plans.summary_queries import BOX_SQL

ENDS = {LOW: "at_low", HIGH: "at_high"}
PANEL = ["treatment", "regime"]


def pts(spark, d, keys=None):
    keys = keys or CURVE
    return curve_points(
        grouped_poly(obs(spark, d), keys, "x", "y"), keys, sequence_points(LOW, HIGH, POINTS)
    )


TOP = f"top AS (SELECT *, max(fit) OVER (PARTITION BY {CURVE_SQL}) AS best FROM pts)"
PEAK = f"""{TOP},
peak AS (SELECT {CURVE_SQL}, min(CASE WHEN fit = best THEN x END) AS topt, max(fit) AS popt,
                count(CASE WHEN fit = best THEN 1 END) AS n_ties FROM top GROUP BY {CURVE_SQL})"""
AREA = f"""seg AS (SELECT *, lag(x) OVER w AS px, lag(fit) OVER w AS pf FROM pts
         WINDOW w AS (PARTITION BY {CURVE_SQL} ORDER BY x)),
area AS (SELECT {CURVE_SQL}, sum((x - px) * (fit + pf) / 2) AS auc,
                sum((x - px) * (fit + pf) / 2) - min(fit) * (max(x) - min(x)) AS auc_base
         FROM seg GROUP BY {CURVE_SQL})"""
ENDS_SQL = f"""ends AS (SELECT {CURVE_SQL}, max(CASE WHEN x = 0 THEN fit END) AS at_low,
                               max(CASE WHEN x = 10 THEN fit END) AS at_high FROM pts GROUP BY {CURVE_SQL})"""


@query(
    "v01_peak",
    f"""WITH {PTS}, {PEAK}
SELECT {CURVE_SQL}, topt, round(popt, 6) AS popt, n_ties, topt IN (0, 10) AS at_edge FROM peak""",
)
def v01(spark, d):
    return rounded(curves.curve_peak(pts(spark, d), CURVE))


@query("v02_area", f"WITH {PTS}, {AREA} SELECT {CURVE_SQL}, round(auc, 6) AS auc FROM area")
def v02(spark, d):
    return rounded(curves.curve_area(pts(spark, d), CURVE))


@query("v03_shifted", f"WITH {PTS}, {AREA} SELECT {CURVE_SQL}, round(auc_base, 6) AS auc FROM area")
def v03(spark, d):
    return rounded(curves.curve_area(pts(spark, d), CURVE, baseline="min", average_repeats=False))


@query(
    "v03_observed",
    f"""WITH {OBS}, m AS (SELECT unit, q, avg(y) AS y FROM obs GROUP BY unit, q),
s AS (SELECT *, lag(q) OVER w AS px, lag(y) OVER w AS py FROM m WINDOW w AS (PARTITION BY unit ORDER BY q))
SELECT unit, round(sum((q - px) * (y + py) / 2) - min(y) * (max(q) - min(q)), 6) AS auc FROM s GROUP BY unit""",
)
def v03_observed(spark, d):
    o = obs(spark, d)
    return rounded(curves.curve_area(o, ["unit"], "q", "y", baseline="min", segments=4))


@query(
    "v04_ends",
    f"WITH {PTS}, {ENDS_SQL} SELECT {CURVE_SQL}, round(at_low, 6) AS at_low, round(at_high, 6) AS at_high FROM ends",
)
def v04(spark, d):
    return rounded(curves.curve_ends(pts(spark, d), CURVE, ENDS))


@query(
    "v05_fourtraits",
    f"""WITH {PTS}, {PEAK}, {ENDS_SQL}
SELECT {CURVE_SQL}, round(at_low, 6) AS at_low, round(at_high, 6) AS at_high, topt, round(popt, 6) AS popt
FROM ends JOIN peak USING ({CURVE_SQL})""",
)
def v05(spark, d):
    return rounded(curves.four_traits(pts(spark, d), CURVE, ENDS))


@query(
    "v06_shape",
    f"""WITH {PTS}, {TOP}
SELECT {CURVE_SQL}, x, round(fit, 6) AS fit, 'Opt' AS metric FROM top WHERE fit = best
UNION ALL SELECT {CURVE_SQL}, x, round(fit, 6), 'Min' FROM pts WHERE x = 0
UNION ALL SELECT {CURVE_SQL}, x, round(fit, 6), 'Max' FROM pts WHERE x = 10""",
)
def v06(spark, d):
    return rounded(curves.shape_rows(pts(spark, d), CURVE, LOW, HIGH))


@query(
    "v07_deltas",
    f"""WITH {PTS}, {PEAK}, {AREA}, j AS (SELECT * FROM peak JOIN area USING ({CURVE_SQL}))
SELECT a.unit, a.regime, round(b.topt - a.topt, 6) AS delta_topt, round(b.popt - a.popt, 6) AS delta_popt,
       round(b.auc_base - a.auc_base, 6) AS delta_auc
FROM (SELECT * FROM j WHERE treatment = 'F') a JOIN (SELECT * FROM j WHERE treatment = 'O') b
  ON a.unit = b.unit AND a.regime = b.regime""",
)
def v07(spark, d):
    return rounded(curves.curve_deltas(pts(spark, d), CURVE, "treatment", "F", "O"))


@query(
    "v08_turning",
    f"""WITH {PTS},
s AS (SELECT {CURVE_SQL}, x, fit,
        (coalesce(lead(fit) OVER w, fit) - coalesce(lag(fit) OVER w, fit))
        / (coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x)) AS slope
      FROM pts WINDOW w AS (PARTITION BY {CURVE_SQL} ORDER BY x)),
r AS (SELECT *, row_number() OVER (PARTITION BY {CURVE_SQL} ORDER BY abs(slope), x) AS place FROM s)
SELECT {CURVE_SQL},
       CASE WHEN min(slope) > 0 THEN max(x) WHEN max(slope) < 0 THEN min(x)
            ELSE max(CASE WHEN place = 1 THEN x END) END AS turn_x,
       round(CASE WHEN min(slope) > 0 THEN arg_max(fit, x) WHEN max(slope) < 0 THEN arg_min(fit, x)
                  ELSE max(CASE WHEN place = 1 THEN fit END) END, 6) AS turn_y
FROM r GROUP BY {CURVE_SQL}""",
)
def v08(spark, d):
    return rounded(curves.turning_point(pts(spark, d), CURVE))


@query(
    "v08_roots",
    f"""WITH {OBS}, {design_sql(CURVE_SQL, CUBIC, name="c")},
t AS (SELECT *, CASE WHEN b2 * b2 - 3 * b3 * b1 > 0
                     THEN (-b2 - sqrt(abs(b2 * b2 - 3 * b3 * b1))) / (3 * b3) END AS tx FROM c)
SELECT {CURVE_SQL}, round(tx, 4) AS turn_x, round(((b3 * tx + b2) * tx + b1) * tx + b0, 3) AS turn_y FROM t""",
)
def v08_roots(spark, d):
    coefs = grouped_poly(obs(spark, d), CURVE, "x", "y", 3)
    out = curves.polynomial_turning_points(coefs, CURVE, 3)
    return out.select(*CURVE, F.round("turn_x", 4).alias("turn_x"), F.round("turn_y", 3).alias("turn_y"))


@query(
    "v09_critical",
    f"""WITH {PTS}, {PEAK}, p AS (SELECT pts.*, topt FROM pts JOIN peak USING ({CURVE_SQL}))
SELECT {CURVE_SQL}, min(topt) AS topt,
       arg_min(CASE WHEN x < topt THEN x END, CASE WHEN x < topt THEN abs(fit - 10.5) END) AS crit_low,
       arg_min(CASE WHEN x > topt THEN x END, CASE WHEN x > topt THEN abs(fit - 10.5) END) AS crit_high
FROM p GROUP BY {CURVE_SQL}""",
)
def v09(spark, d):
    return rounded(curves.critical_limits(pts(spark, d), CURVE, 10.5))


@query(
    "v10_edges",
    f"WITH {PTS}, {TOP} SELECT {CURVE_SQL}, x, round(fit, 6) AS fit FROM top WHERE fit = best AND x = 10",
)
def v10(spark, d):
    return rounded(curves.edge_optima(pts(spark, d), CURVE))


@query(
    "v10_excluded",
    f"""WITH {PTS}, {TOP},
marked AS (SELECT *, bool_or(fit = best AND x = 10) OVER (PARTITION BY {CURVE_SQL}) AS at_end FROM top)
SELECT {CURVE_SQL}, x, round(fit, 6) AS fit FROM marked WHERE NOT at_end""",
)
def v10_excluded(spark, d):
    points = pts(spark, d)
    return rounded(curves.exclude_curves(points, curves.edge_optima(points, CURVE), CURVE))


@query(
    "v11_summary",
    f"""WITH {PTS}, {AREA}
SELECT treatment, regime, count(auc) AS n, round(avg(auc), 6) AS mean,
       round(stddev_samp(auc) / sqrt(count(auc)), 6) AS se FROM area GROUP BY 1, 2""",
)
def v11(spark, d):
    """The whole chain: rows, curves, areas, mean and SE across units per cell."""
    areas = curves.curve_area(pts(spark, d), CURVE, average_repeats=False)
    return rounded(mean_se(areas, PANEL, "auc"))


@query(
    "v11_optima",
    f"""WITH {PTS}, {PEAK}
SELECT treatment, regime, round(avg(popt), 6) AS mean_p, round(stddev_samp(popt) / sqrt(count(*)), 6) AS se_p,
       round(avg(topt), 6) AS mean_t, round(stddev_samp(topt) / sqrt(count(*)), 6) AS se_t FROM peak GROUP BY 1, 2""",
)
def v11_optima(spark, d):
    peak = curves.curve_peak(pts(spark, d), CURVE)
    both = []
    for name, trait in (("p", "popt"), ("t", "topt")):
        both += [
            F.avg(trait).alias(f"mean_{name}"),
            standard_error(F.col(trait), "rows").alias(f"se_{name}"),
        ]
    return rounded(peak.groupBy(*PANEL).agg(*both))


@query(
    "v12_endpeak",
    f"""WITH {PTS}, {PEAK}, {ENDS_SQL}
SELECT treatment, regime, regr_count(at_low, popt) AS n, round(regr_intercept(at_low, popt), 5) AS intercept,
       round(regr_slope(at_low, popt), 5) AS slope, round(regr_r2(at_low, popt), 5) AS r2
FROM ends JOIN peak USING ({CURVE_SQL}) GROUP BY 1, 2""",
)
def v12(spark, d):
    traits = curves.four_traits(pts(spark, d), CURVE, ENDS)
    return rounded(curves.end_on_peak(traits, PANEL, "at_low", "popt"), 5)


# --- tables behind figures -------------------------------------------------


@query(
    "p01_lines",
    f"""WITH {OBS}, {quadratic_sql(CURVE_SQL, y="y_na")},
r AS (SELECT {CURVE_SQL}, CAST(min(x) AS DOUBLE) AS lo, CAST(max(x) AS DOUBLE) AS hi FROM obs
      WHERE y_na IS NOT NULL GROUP BY {CURVE_SQL}),
l AS (SELECT {CURVE_SQL}, lo + i * ((hi - lo) / 79) AS x, b0, b1, b2
      FROM q JOIN r USING ({CURVE_SQL}) CROSS JOIN range(80) t(i))
SELECT {CURVE_SQL}, round(x, 6) AS x, round((b2 * x + b1) * x + b0, 6) AS fit FROM l WHERE b2 IS NOT NULL""",
)
def p01(spark, d):
    return rounded(plotting.smooth_lines(obs(spark, d), CURVE, "x", "y_na"))


@query(
    "p02_errorbars",
    f"""WITH {OBS}, s AS (SELECT treatment, regime, x, avg(y_na) AS m,
      stddev_samp(y_na) / sqrt(count(y_na)) AS se FROM obs GROUP BY 1, 2, 3)
SELECT treatment, regime, x, round(m, 6) AS mean, round(m - se, 6) AS lower, round(m + se, 6) AS upper FROM s""",
)
def p02(spark, d):
    return rounded(plotting.error_bars(obs(spark, d), [*PANEL, "x"], "y_na"))


PANEL_PTS = PTS.replace(CURVE_SQL, "treatment, regime")


@query(
    "p03_reflines",
    f"""WITH {PANEL_PTS}
SELECT treatment, regime, arg_max(x, fit) AS topt, round(max(fit), 6) AS popt FROM pts GROUP BY 1, 2""",
)
def p03(spark, d):
    return rounded(plotting.reference_lines(pts(spark, d, PANEL), PANEL))


@query(
    "p04_boxes",
    f"WITH {OBS}, " + BOX_SQL.format(k="treatment, regime, x", y="y_na", t="obs") + " SELECT * FROM box",
)
def p04(spark, d):
    return rounded(plotting.boxes(obs(spark, d), [*PANEL, "x"], "y_na"))


@query(
    "p05_widerange",
    f"""WITH {OBS}, {quadratic_sql(CURVE_SQL)},
w AS (SELECT -5 + CAST(i AS DOUBLE) * 0.25 AS x FROM range(81) t(i))
SELECT {CURVE_SQL}, w.x, round((b2 * w.x + b1) * w.x + b0, 5) AS fit FROM q CROSS JOIN w WHERE b2 IS NOT NULL""",
)
def p05(spark, d):
    coefs = grouped_poly(obs(spark, d), CURVE, "x", "y")
    return rounded(plotting.wide_range_curves(coefs, CURVE, -5.0, 15.0, 81), 5)
