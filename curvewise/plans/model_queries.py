"""Model fits (M). Queries without SQL twin are iterative or use special functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvewise.operators import absorbing, fitting, hierarchical, linear, mixed, nonlinear, smooth
from curvewise.operators.curves import peak_and_area
from curvewise.operators.joining import prediction_grid, sequence_points
from curvewise.operators.summarising import mean_se
from curvewise.plans.base import (
    CURVE,
    CURVE_SQL,
    GRID,
    HIGH,
    LOW,
    OBS,
    POINTS,
    design_sql,
    obs,
    quadratic_sql,
    query,
    rounded,
    solve_sql,
    table,
)

COEFS = "round(b0, 5) AS b0, round(b1, 5) AS b1"
FIT_TAIL = "round(sse, 5) AS sse, round(sst, 5) AS sst, round(r2, 5) AS r2"


def grid():
    return sequence_points(LOW, HIGH, POINTS)


@query(
    "m01_linear",
    f"""WITH {OBS}
SELECT {CURVE_SQL}, regr_count(y_na, CAST(x AS DOUBLE)) AS n,
       round(regr_intercept(y_na, CAST(x AS DOUBLE)), 6) AS intercept,
       round(regr_slope(y_na, CAST(x AS DOUBLE)), 6) AS slope,
       round(regr_r2(y_na, CAST(x AS DOUBLE)), 6) AS r2
FROM obs GROUP BY {CURVE_SQL}""",
)
def m01(spark, d):
    return rounded(fitting.grouped_linear(obs(spark, d), CURVE, "x", "y_na"))


@query(
    "m02_quadratic",
    f"WITH {OBS}, {quadratic_sql(CURVE_SQL, y='y_na')}"
    f" SELECT {CURVE_SQL}, n, {COEFS}, round(b2, 5) AS b2, {FIT_TAIL} FROM q",
)
def m02(spark, d):
    return rounded(fitting.grouped_poly(obs(spark, d), CURVE, "x", "y_na", 2), 5)


CUBIC = ["x", "CAST(x AS DOUBLE) * x", "CAST(x AS DOUBLE) * x * x"]


@query(
    "m03_cubic",
    f"WITH {OBS}, {design_sql(CURVE_SQL, CUBIC)}"
    f" SELECT {CURVE_SQL}, n, {COEFS}, round(b2, 5) AS b2, round(b3, 5) AS b3, {FIT_TAIL} FROM q",
)
def m03(spark, d):
    return rounded(fitting.grouped_poly(obs(spark, d), CURVE, "x", "y", 3), 5)


CENTRED = ["xc", "xc * xc", "xc * xc * xc"]


@query(
    "m03_shifted",
    f"""WITH {OBS},
oc AS (SELECT *, x - avg(x) OVER (PARTITION BY {CURVE_SQL}) AS xc FROM obs),
mid AS (SELECT {CURVE_SQL}, avg(x) + 2000 AS center FROM obs GROUP BY {CURVE_SQL}),
{design_sql(CURVE_SQL, CENTRED, "oc")}
SELECT {CURVE_SQL}, n, round(center, 5) AS center, {COEFS}, round(b2, 5) AS b2, round(b3, 5) AS b3, {FIT_TAIL}
FROM q JOIN mid USING ({CURVE_SQL})""",
)
def m03_shifted(spark, d):
    """The cubic with x as if it were years: the fit must not depend on where x lies."""
    years = obs(spark, d).withColumn("x", F.col("x") + 2000)
    return rounded(fitting.grouped_poly(years, CURVE, "x", "y", 3, centred=True), 5)


FRACTIONAL = ["x", "ln(x + 1)", "CAST(x AS DOUBLE) * x"]


@query(
    "m04_fractional",
    f"WITH {OBS}, {design_sql(CURVE_SQL, FRACTIONAL)}"
    f" SELECT {CURVE_SQL}, n, {COEFS}, round(b2, 5) AS b2, round(b3, 5) AS b3, {FIT_TAIL} FROM q",
)
def m04(spark, d):
    return rounded(fitting.grouped_fractional(obs(spark, d), CURVE, "x", "y", shift=1.0), 5)


# --- factorial models ------------------------------------------------------


def factorial(spark, d, y="y_na"):
    terms = linear.crossed("treatment", "regime")
    return linear.fit_linear(obs(spark, d), y, terms, factors=["treatment", "regime"])


def covariate(spark, d):
    terms = linear.crossed("x", "treatment", "regime")
    return linear.fit_linear(
        obs(spark, d), "y_na", terms, factors=["treatment", "regime"], numeric={"x": 1}
    )


CELLS = f"""WITH {OBS},
c AS (SELECT treatment, regime, count(y_na) AS n, avg(y_na) AS m, var_pop(y_na) * count(y_na) AS ss
      FROM obs GROUP BY 1, 2),
w AS (SELECT sum(ss) / (sum(n) - 4) AS mse,
        max(CASE WHEN treatment = 'F' AND regime = 'open' THEN m END) AS m00,
        max(CASE WHEN treatment = 'O' AND regime = 'open' THEN m END) AS m10,
        max(CASE WHEN treatment = 'F' AND regime = 'settled' THEN m END) AS m01,
        max(CASE WHEN treatment = 'O' AND regime = 'settled' THEN m END) AS m11,
        max(CASE WHEN treatment = 'F' AND regime = 'open' THEN 1.0 / n END) AS v00,
        max(CASE WHEN treatment = 'O' AND regime = 'open' THEN 1.0 / n END) AS v10,
        max(CASE WHEN treatment = 'F' AND regime = 'settled' THEN 1.0 / n END) AS v01,
        max(CASE WHEN treatment = 'O' AND regime = 'settled' THEN 1.0 / n END) AS v11 FROM c),
est AS (SELECT '(intercept)' AS term, m00 AS b, sqrt(mse * v00) AS se FROM w
  UNION ALL SELECT 'treatment[O]', m10 - m00, sqrt(mse * (v10 + v00)) FROM w
  UNION ALL SELECT 'regime[settled]', m01 - m00, sqrt(mse * (v01 + v00)) FROM w
  UNION ALL SELECT 'treatment[O]:regime[settled]', m11 - m10 - m01 + m00,
                   sqrt(mse * (v00 + v10 + v01 + v11)) FROM w)
"""


@query("m05_factorial", CELLS + "SELECT term, round(b, 6) AS estimate FROM est")
def m05(spark, d):
    return rounded(linear.tidy(spark, factorial(spark, d)).select("term", "estimate"))


@query(
    "m06_tidy",
    CELLS + "SELECT term, round(b, 6) AS estimate, round(se, 6) AS std_error,"
    " round(b / se, 6) AS statistic FROM est",
)
def m06(spark, d):
    return rounded(linear.tidy(spark, factorial(spark, d)).drop("p_value"))


@query("m06_pvalues")
def m06_pvalues(spark, d):
    return rounded(linear.tidy(spark, covariate(spark, d)))


@query(
    "m07_predict",
    f"""WITH {OBS}, {GRID},
c AS (SELECT treatment, regime, count(*) AS n, regr_intercept(y_na, CAST(x AS DOUBLE)) AS a,
             regr_slope(y_na, CAST(x AS DOUBLE)) AS b, avg(CAST(x AS DOUBLE)) AS mx,
             var_pop(CAST(x AS DOUBLE)) * count(*) AS sxx,
             (var_pop(y_na) - covar_pop(x, y_na) * covar_pop(x, y_na) / var_pop(CAST(x AS DOUBLE))) * count(*) AS sse
      FROM obs WHERE y_na IS NOT NULL GROUP BY 1, 2),
s AS (SELECT sum(sse) / (sum(n) - 8) AS mse FROM c)
SELECT treatment, regime, grid.x, round(a + b * grid.x, 6) AS fit,
       round(sqrt(mse * (1.0 / n + (grid.x - mx) * (grid.x - mx) / sxx)), 6) AS se
FROM c CROSS JOIN s CROSS JOIN grid""",
)
def m07(spark, d):
    cells = obs(spark, d).select("treatment", "regime").distinct()
    points = cells.withColumn("x", F.explode(grid()))
    out = linear.predict_linear(covariate(spark, d), points, level=0.95)
    return rounded(out.drop("lower", "upper"))


# Both factors as 0/1 columns: sums of squares of the additive and single models.
ADDITIVE = f"""WITH {OBS},
f AS (SELECT 1 AS k, treatment, regime, y_na, CASE WHEN treatment = 'O' THEN 1.0 ELSE 0.0 END AS a,
             CASE WHEN regime = 'settled' THEN 1.0 ELSE 0.0 END AS b FROM obs WHERE y_na IS NOT NULL),
{design_sql("k", ["a"], "f", "y_na", "ma")}, {design_sql("k", ["b"], "f", "y_na", "mb")},
{design_sql("k", ["a", "b"], "f", "y_na", "mab")},
cells AS (SELECT sum(v) AS sse, sum(n) - 4 AS dof FROM (
  SELECT var_pop(y_na) * count(*) AS v, count(*) AS n FROM f GROUP BY treatment, regime)),
w AS (SELECT ma.sse AS sa, mb.sse AS sb, mab.sse AS sab, ma.sst AS sst, cells.sse AS sse, dof,
             cells.sse / dof AS mse FROM ma, mb, mab, cells)
"""
TYPE2 = """
t AS (SELECT 'treatment' AS term, sb - sab AS ss, * FROM w
  UNION ALL SELECT 'regime', sa - sab, * FROM w
  UNION ALL SELECT 'treatment:regime', sab - sse, * FROM w)"""


@query(
    "m08_marginal",
    f"""{ADDITIVE}, {TYPE2}
SELECT term, CAST(1 AS INT) AS df, round(ss, 6) AS sum_sq, round(ss / mse, 5) AS f_value FROM t
UNION ALL SELECT 'Residuals', CAST(dof AS INT), round(sse, 6), NULL FROM w""",
)
def m08(spark, d):
    out = linear.anova_marginal(spark, factorial(spark, d))
    return out.select(
        "term", "df", F.round("sum_sq", 6).alias("sum_sq"), F.round("f_value", 5).alias("f_value")
    )


@query("m08_pvalues")
def m08_pvalues(spark, d):
    return rounded(linear.anova_marginal(spark, covariate(spark, d)))


@query(
    "m09_sequential",
    f"""{ADDITIVE}
SELECT 'treatment' AS term, CAST(1 AS INT) AS df, round(sst - sa, 6) AS sum_sq, round((sst - sa) / mse, 5) AS f_value FROM w
UNION ALL SELECT 'regime', 1, round(sa - sab, 6), round((sa - sab) / mse, 5) FROM w
UNION ALL SELECT 'treatment:regime', 1, round(sab - sse, 6), round((sab - sse) / mse, 5) FROM w
UNION ALL SELECT 'Residuals', CAST(dof AS INT), round(sse, 6), NULL FROM w""",
)
def m09(spark, d):
    out = linear.anova_sequential(spark, factorial(spark, d))
    return out.select(
        "term", "df", F.round("sum_sq", 6).alias("sum_sq"), F.round("f_value", 5).alias("f_value")
    )


@query(
    "m10_eta",
    f"{ADDITIVE}, {TYPE2} SELECT term, round(ss / (ss + sse), 8) AS eta_sq FROM t",
)
def m10(spark, d):
    out = linear.effect_sizes(linear.anova_marginal(spark, factorial(spark, d)))
    return rounded(out.select("term", "eta_sq"), 8)


@query(
    "m11_omega",
    f"{ADDITIVE}, {TYPE2} SELECT term, round((ss - mse) / (sst + mse), 8) AS omega_sq FROM t",
)
def m11(spark, d):
    out = linear.effect_sizes(linear.anova_marginal(spark, factorial(spark, d)))
    return rounded(out.select("term", "omega_sq"), 8)


@query("m12_manova")
def m12(spark, d):
    """Optimum, peak and area of each unit's curve on the two factors at once."""
    pts = fitting.curve_points(fitting.grouped_poly(obs(spark, d), CURVE, "x", "y"), CURVE, grid())
    traits = peak_and_area(pts, CURVE, baseline="min")
    fit = linear.fit_linear(
        traits, ["topt", "popt", "auc"], linear.crossed("regime", "treatment"),
        factors=["regime", "treatment"],
    )
    return rounded(linear.manova(spark, fit))


# --- mixed models ----------------------------------------------------------

PANEL = ["treatment", "regime"]
MOMENTS = f"""WITH {OBS}, {quadratic_sql("treatment, regime", y="y_na")},
res AS (SELECT unit, y_na - ((b2 * x + b1) * x + b0) AS r FROM obs JOIN q USING (treatment, regime)
        WHERE y_na IS NOT NULL),
u AS (SELECT unit, count(*) AS n, avg(r) AS mean, var_pop(r) AS v FROM res GROUP BY unit),
g AS (SELECT sum(n) AS rows, count(*) AS units, sum(n * mean) / sum(n) AS grand_mean,
             sum(CAST(n AS DOUBLE) * n) AS nn, sum(n * v) AS within FROM u),
bt AS (SELECT sum(n * (mean - grand_mean) * (mean - grand_mean)) AS between FROM u, g),
vc AS (SELECT CAST(rows AS BIGINT) AS rows, units, grand_mean, within / (rows - units) AS sigma2,
              greatest((between / (units - 1) - within / (rows - units))
                       / ((rows - nn / rows) / (units - 1)), CAST(0 AS DOUBLE)) AS tau2 FROM g, bt),
off AS (SELECT unit, n, mean, n * tau2 / (n * tau2 + sigma2) AS shrink,
               n * tau2 / (n * tau2 + sigma2) * (mean - grand_mean) AS "offset" FROM u, vc)
"""


def moments(spark, d):
    return mixed.fit_mixed_moments(obs(spark, d), PANEL, "unit", "x", "y_na")


@query(
    "m13_variance",
    MOMENTS + "SELECT rows, units, round(sigma2, 6) AS sigma2, round(tau2, 6) AS tau2 FROM vc",
)
def m13(spark, d):
    return rounded(moments(spark, d).variance.drop("grand_mean"))


@query("m13_reml")
def m13_reml(spark, d):
    return rounded(mixed.variance_table(spark, _reml(spark, d, ({},))))


CURVES = ({}, {"x": 1}, {"x": 2})


def _reml(spark, d, random):
    return mixed.fit_mixed(
        obs(spark, d), "y_na", linear.crossed("x", "treatment", "regime"), "unit",
        factors=PANEL, numeric={"x": 2}, random=random,
    )


@query("m14_curves")
def m14(spark, d):
    return rounded(mixed.variance_table(spark, _reml(spark, d, CURVES)))


@query(
    "m15_predict",
    f"""{MOMENTS}, {GRID}
SELECT off.unit, treatment, regime, grid.x, round((b2 * grid.x + b1) * grid.x + b0, 6) AS fixed_pred,
       round((b2 * grid.x + b1) * grid.x + b0 + "offset", 6) AS unit_pred
FROM off CROSS JOIN q CROSS JOIN grid""",
)
def m15(spark, d):
    return rounded(mixed.predict_mixed_moments(moments(spark, d), LOW, HIGH, POINTS))


@query("m15_curves")
def m15_curves(spark, d):
    """Every supplier's own curve, and that of its cell, from the random-curve fit."""
    rows = obs(spark, d)
    points = prediction_grid(rows, "unit", PANEL, "x", LOW, HIGH, POINTS)
    return rounded(mixed.predict_mixed(_reml(spark, d, CURVES), points), 4)


@query(
    "m16_ranef",
    MOMENTS + 'SELECT unit, n, round(mean, 6) AS mean, round(shrink, 6) AS shrink,'
    ' round("offset", 6) AS "offset" FROM off',
)
def m16(spark, d):
    return rounded(moments(spark, d).offsets)


@query("m16_curves")
def m16_curves(spark, d):
    return rounded(mixed.unit_effects(_reml(spark, d, CURVES)), 4)


@query("m17_lrt")
def m17(spark, d):
    return rounded(mixed.likelihood_ratio(spark, _reml(spark, d, ({},)), _reml(spark, d, CURVES)))


@query("m18_wald")
def m18(spark, d):
    return rounded(mixed.wald_tests(spark, _reml(spark, d, ({}, {"x": 1}))))


# --- nonlinear curves ------------------------------------------------------

VERTEX = f"""WITH {OBS}, {quadratic_sql(CURVE_SQL)},
v AS (SELECT *, b2 AS a, -b1 / (2 * b2) AS h, b0 - b1 * b1 / (4 * b2) AS k, b2 > 0 AS convex FROM q)
"""


@query(
    "m19_vertex",
    VERTEX + f"SELECT {CURVE_SQL}, n, round(a, 5) AS a, round(h, 4) AS h, round(k, 4) AS k, convex FROM v",
)
def m19(spark, d):
    out = fitting.grouped_vertex(obs(spark, d), CURVE, "x", "y")
    return out.select(
        *CURVE, "n", F.round("a", 5).alias("a"), F.round("h", 4).alias("h"),
        F.round("k", 4).alias("k"), "convex",
    )


def lattice_sql(name: str, low: float, high: float, n: int) -> str:
    step = (high - low) / (n - 1)
    return (
        f"{name}_v AS (SELECT CAST({low} AS DOUBLE) + i * CAST({step!r} AS DOUBLE) AS {name}"
        f" FROM range({n}) t(i))"
    )


XSUMS = f"""WITH {OBS},
xs AS (SELECT {CURVE_SQL}, CAST(x AS DOUBLE) AS x, count(*) AS n, avg(y) AS mean, var_pop(y) * count(*) AS ss
       FROM obs GROUP BY {CURVE_SQL}, x)"""
LACTIN = {"p": (0.05, 0.25, 5), "tmax": (11.0, 16.0, 6), "dt": (1.0, 4.0, 4)}
THETA = {"k": (11.0, 20.0, 10), "theta": (0.5, 3.0, 6)}


@query(
    "m20_lactin",
    f"""{XSUMS}, {", ".join(lattice_sql(k, *v) for k, v in LACTIN.items())},
e AS (SELECT *, exp(p * x) - exp(p * tmax - (tmax - x) / dt) AS g
      FROM xs CROSS JOIN p_v CROSS JOIN tmax_v CROSS JOIN dt_v),
s AS (SELECT {CURVE_SQL}, p, tmax, dt, sum(n * (mean - g)) / sum(n) AS lam, sum(n) AS n,
             sum(ss + n * (mean - g) * (mean - g)) - sum(n * (mean - g)) * sum(n * (mean - g)) / sum(n) AS sse
      FROM e GROUP BY {CURVE_SQL}, p, tmax, dt)
SELECT {CURVE_SQL}, round(p, 6) AS p, round(tmax, 6) AS tmax, round(dt, 6) AS dt, round(lam, 4) AS lam,
       CAST(n AS BIGINT) AS n, round(sse, 4) AS sse
FROM s QUALIFY row_number() OVER (PARTITION BY {CURVE_SQL} ORDER BY sse, p, tmax, dt) = 1""",
)
def m20(spark, d):
    out = nonlinear.grouped_nonlinear(obs(spark, d), CURVE, "x", "y", "lactin2", lattice=LACTIN)
    return _lattice_rounded(out)


def _lattice_rounded(out):
    """Fine on the lattice coordinates, coarser on values that come from large sums."""
    coarse = {"lam", "r", "a", "sse"}
    return out.select(
        *[
            F.round(F.col(c), 4 if c in coarse else 6).alias(c) if t == "double" else F.col(c)
            for c, t in out.dtypes
        ]
    )


#: These tables have no such curve in them, so many groups wander along ridges; `converged` of m20_refined says
#: which, and m22_all goes on from there.
ROUNDS = 12


@query("m20_refined")
def m20_refined(spark, d):
    fit = nonlinear.grouped_nonlinear(
        obs(spark, d), CURVE, "x", "y", "lactin2", lattice=LACTIN, steps=ROUNDS
    )
    return rounded(fit, 3)


@query(
    "m21_theta",
    f"""{XSUMS}, {", ".join(lattice_sql(k, *v) for k, v in THETA.items())},
e AS (SELECT *, x * (1 - power(x / k, theta)) AS g FROM xs CROSS JOIN k_v CROSS JOIN theta_v),
s AS (SELECT {CURVE_SQL}, k, theta, sum(n * mean * g) / sum(n * g * g) AS r, sum(n) AS n,
             sum(ss + n * mean * mean) - sum(n * mean * g) * sum(n * mean * g) / sum(n * g * g) AS sse
      FROM e GROUP BY {CURVE_SQL}, k, theta)
SELECT {CURVE_SQL}, round(k, 6) AS k, round(theta, 6) AS theta, round(r, 4) AS r, CAST(n AS BIGINT) AS n,
       round(sse, 4) AS sse
FROM s QUALIFY row_number() OVER (PARTITION BY {CURVE_SQL} ORDER BY sse, k, theta) = 1""",
)
def m21(spark, d):
    out = nonlinear.grouped_nonlinear(obs(spark, d), CURVE, "x", "y", "theta_logistic", lattice=THETA)
    return _lattice_rounded(out)


def aic_sql(sse: str, k: int) -> str:
    return f"n * ln(nullif({sse}, 0) / n) + 2 * {k}"


@query(
    "m22_families",
    f"""WITH {OBS}, {quadratic_sql(CURVE_SQL)}, {design_sql(CURVE_SQL, CUBIC, name="c")},
{design_sql(CURVE_SQL, FRACTIONAL, name="f")},
m AS (SELECT {CURVE_SQL}, n, 'quadratic' AS model, sse, {aic_sql("sse", 4)} AS aic FROM q
  UNION ALL SELECT {CURVE_SQL}, n, 'cubic', sse, {aic_sql("sse", 5)} FROM c
  UNION ALL SELECT {CURVE_SQL}, n, 'fractional', sse, {aic_sql("sse", 5)} FROM f)
SELECT {CURVE_SQL}, n, model, round(sse, 5) AS sse, round(aic, 5) AS aic,
       first_value(model) OVER (PARTITION BY {CURVE_SQL} ORDER BY aic NULLS LAST, model) AS best FROM m""",
)
def m22(spark, d):
    out = nonlinear.compare_models(obs(spark, d), CURVE, "x", "y", curves=(), shift=1.0)
    return rounded(out.select(*CURVE, "n", "model", "sse", "aic", "best"), 5)


BRIERE1 = {"t0": (-6.0, -1.0, 6), "tm": (10.5, 20.0, 6)}
BRIERE2 = {**BRIERE1, "m": (1.0, 4.0, 4)}
LATTICES = {"lactin2": LACTIN, "theta_logistic": THETA, "briere1": BRIERE1, "briere2": BRIERE2}


def lattice_best_sql(model: str, lattice: dict, curve: str, kind: str) -> str:
    """CTEs ending in `<model>` (keys, n, sse): the best lattice point of a curve form."""
    values = ", ".join(lattice_sql(p, *r).replace(f"{p}_v AS", f"{model}_{p} AS") for p, r in lattice.items())
    cross = " ".join(f"CROSS JOIN {model}_{p}" for p in lattice)
    sse = {
        "offset": "sum(ss + n * (mean - g) * (mean - g)) - sum(n * (mean - g)) * sum(n * (mean - g)) / sum(n)",
        "scale": "sum(ss + n * mean * mean) - sum(n * mean * g) * sum(n * mean * g) / nullif(sum(n * g * g), 0)",
    }[kind]
    return f"""{values},
{model} AS (SELECT {CURVE_SQL}, min(n) AS n, min(sse) AS sse FROM (
  SELECT {CURVE_SQL}, {", ".join(lattice)}, CAST(sum(n) AS BIGINT) AS n, {sse} AS sse
  FROM (SELECT *, {curve} AS g FROM xs {cross}) GROUP BY {CURVE_SQL}, {", ".join(lattice)})
  GROUP BY {CURVE_SQL})"""


INSIDE = "CASE WHEN x > t0 AND x < tm THEN x * (x - t0) * {root} ELSE 0 END"


@query(
    "m22_lattice",
    f"""{XSUMS}, {quadratic_sql(CURVE_SQL)}, {design_sql(CURVE_SQL, CUBIC, name="c")},
{design_sql(CURVE_SQL, FRACTIONAL, name="f")},
{lattice_best_sql("lac", LACTIN, "exp(p * x) - exp(p * tmax - (tmax - x) / dt)", "offset")},
{lattice_best_sql("the", THETA, "x * (1 - power(x / k, theta))", "scale")},
{lattice_best_sql("br1", BRIERE1, INSIDE.format(root="sqrt(greatest(tm - x, 0))"), "scale")},
{lattice_best_sql("br2", BRIERE2, INSIDE.format(root="power(greatest(tm - x, 0), 1 / m)"), "scale")},
m AS (SELECT {CURVE_SQL}, n, 'quadratic' AS model, sse, {aic_sql("sse", 4)} AS aic FROM q
  UNION ALL SELECT {CURVE_SQL}, n, 'cubic', sse, {aic_sql("sse", 5)} FROM c
  UNION ALL SELECT {CURVE_SQL}, n, 'fractional', sse, {aic_sql("sse", 5)} FROM f
  UNION ALL SELECT {CURVE_SQL}, n, 'lactin2', sse, {aic_sql("sse", 5)} FROM lac
  UNION ALL SELECT {CURVE_SQL}, n, 'theta_logistic', sse, {aic_sql("sse", 4)} FROM the
  UNION ALL SELECT {CURVE_SQL}, n, 'briere1', sse, {aic_sql("sse", 4)} FROM br1
  UNION ALL SELECT {CURVE_SQL}, n, 'briere2', sse, {aic_sql("sse", 5)} FROM br2)
SELECT {CURVE_SQL}, n, model, round(sse, 4) AS sse, round(aic, 4) AS aic,
       first_value(model) OVER (PARTITION BY {CURVE_SQL} ORDER BY aic NULLS LAST, model) AS best FROM m""",
)
def m22_lattice(spark, d):
    out = nonlinear.compare_models(obs(spark, d), CURVE, "x", "y", lattices=LATTICES, steps=0, shift=1.0)
    return rounded(out.select(*CURVE, "n", "model", "sse", "aic", "best"), 4)


@query("m22_all")
def m22_all(spark, d):
    """All families, the nonlinear ones refined to tolerance from the lattice, each fit to its end."""
    out = nonlinear.compare_models(obs(spark, d), CURVE, "x", "y", lattices=LATTICES, steps=ROUNDS, shift=1.0)
    return rounded(out.select(*CURVE, "n", "model", "converged", "sse", "aic", "best"), 4)


@query(
    "m23_aic",
    f"""WITH {OBS}, {design_sql(CURVE_SQL, ["x"], name="l")}, {quadratic_sql(CURVE_SQL)},
{design_sql(CURVE_SQL, CUBIC, name="c")},
a AS (SELECT {CURVE_SQL}, c.n AS n, {aic_sql("l.sse", 3).replace("n *", "c.n *").replace("/ n", "/ c.n")} AS a1,
  {aic_sql("q.sse", 4).replace("n *", "c.n *").replace("/ n", "/ c.n")} AS a2,
  {aic_sql("c.sse", 5).replace("n *", "c.n *").replace("/ n", "/ c.n")} AS a3
  FROM l JOIN q USING ({CURVE_SQL}) JOIN c USING ({CURVE_SQL}))
SELECT {CURVE_SQL}, n, round(a1, 5) AS aic_linear, round(a2, 5) AS aic_quadratic, round(a3, 5) AS aic_cubic,
       CASE WHEN a1 <= coalesce(a2, a1) AND a1 <= coalesce(a3, a1) THEN 'linear'
            WHEN a2 <= coalesce(a3, a2) THEN 'quadratic' ELSE 'cubic' END AS best,
       round(a1 - a2, 5) AS delta_aic FROM a""",
)
def m23(spark, d):
    return rounded(fitting.polynomial_aics(obs(spark, d), CURVE, "x", "y"), 5)


# --- smooths and diagnostics -----------------------------------------------

KNOTS = [2.5, 5.0, 7.5]


@query("m24_smooth")
def m24(spark, d):
    out = smooth.grouped_smooth(obs(spark, d), CURVE, "x", "y", KNOTS)
    return rounded(out.drop("coefs"), 5)


@query("m24_offsets")
def m24_offsets(spark, d):
    _, _, offsets = smooth.smooth_with_offsets(obs(spark, d), PANEL, "unit", "x", "y", KNOTS)
    return rounded(offsets, 5)


def _sales(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_suppkey", "l_partkey", "l_quantity", "l_discount", F.log("l_extendedprice").alias("y"))


@query("m05_absorbed")
def m05_absorbed(spark, d):
    """Supplier and part effects, with slopes of quantity and discount, all levels absorbed."""
    fit = absorbing.fit_absorbed(_sales(spark, d), "y", ["l_partkey", "l_suppkey"], ["l_quantity", "l_discount"])
    return rounded(absorbing.tidy_absorbed(spark, fit), 6)


@query("m09_absorbed")
def m09_absorbed(spark, d):
    """Sequential table of parts, then suppliers."""
    return rounded(absorbing.anova_absorbed(_sales(spark, d), "y", ["l_partkey", "l_suppkey"], ["l_quantity"]), 4)


@query("m24_joint")
def m24_joint(spark, d):
    """Common and group curves of one fit, a penalty of its own for each group."""
    fit = hierarchical.joint_smooth(obs(spark, d), CURVE, "x", "y", KNOTS, "separate")
    return rounded(hierarchical.joint_points(fit, grid()), 5)


@query("m24_wiggliness")
def m24_wiggliness(spark, d):
    return rounded(hierarchical.compare_wiggliness(obs(spark, d), CURVE, "x", "y", KNOTS), 4)


def _loess_sql(span: str) -> str:
    det, solutions = solve_sql(3, "p", "h", "1e-12")
    return f"""{XSUMS}, {GRID},
e AS (SELECT {CURVE_SQL}, xs.x - grid.x AS e, grid.x AS pt, n, mean,
        {span} * greatest(grid.x - min(xs.x) OVER w, max(xs.x) OVER w - grid.x) AS reach
      FROM xs CROSS JOIN grid WINDOW w AS (PARTITION BY {CURVE_SQL}, grid.x)),
k AS (SELECT *, n * CASE WHEN abs(e) < reach THEN power(1 - power(abs(e) / reach, 3), 3) ELSE 0 END AS w FROM e),
m AS (SELECT {CURVE_SQL}, pt, sum(w) AS p00, sum(w * e) AS p01, sum(w * e * e) AS p02,
        sum(w * e * e) AS p11, sum(w * e * e * e) AS p12, sum(w * e * e * e * e) AS p22,
        sum(w * mean) AS h0, sum(w * e * mean) AS h1, sum(w * e * e * mean) AS h2
      FROM k GROUP BY {CURVE_SQL}, pt)
SELECT {CURVE_SQL}, pt AS x, round({solutions[0]}, 6) AS fit FROM (SELECT *, {det} AS det FROM m)"""


@query("m25_local", _loess_sql("CAST(1.5 AS DOUBLE)"))
def m25(spark, d):
    return rounded(smooth.local_regression(obs(spark, d), CURVE, "x", "y", 1.5, grid()))


@query(
    "m26_residuals",
    f"""WITH {OBS}, {quadratic_sql(CURVE_SQL, y="y_na")},
r AS (SELECT {CURVE_SQL}, x, y_na, (b2 * x + b1) * x + b0 AS fitted, n, sse
      FROM obs JOIN q USING ({CURVE_SQL}))
SELECT {CURVE_SQL}, x, round(y_na, 6) AS y_na, round(fitted, 6) AS fitted, round(y_na - fitted, 6) AS resid,
       round((y_na - fitted) / sqrt(sse / nullif(n - 3, 0)), 6) AS std_resid FROM r""",
)
def m26(spark, d):
    o = obs(spark, d)
    coefs = fitting.grouped_poly(o, CURVE, "x", "y_na", 2)
    return rounded(fitting.augment(o, coefs, CURVE, "x", "y_na"))


@query(
    "m27_summary",
    VERTEX + """, k AS (SELECT treatment, regime, 'a' AS coef, a AS v FROM v
  UNION ALL SELECT treatment, regime, 'h', h FROM v UNION ALL SELECT treatment, regime, 'k', k FROM v)
SELECT treatment, regime, coef, count(v) AS n, round(avg(v), 3) AS mean,
       round(stddev_samp(v) / sqrt(count(v)), 3) AS se FROM k GROUP BY 1, 2, 3""",
)
def m27(spark, d):
    vertices = fitting.grouped_vertex(obs(spark, d), CURVE, "x", "y")
    rows = vertices.unpivot(PANEL, ["a", "h", "k"], "coef", "v")
    return rounded(mean_se(rows, [*PANEL, "coef"], "v"), 3)


@query("m28_vertices")
def m28(spark, d):
    """Vertices of every supplier's curve in all four cells."""
    return rounded(mixed.cell_vertices(_reml(spark, d, CURVES), "x"), 4)
