"""Derived traits (T) on the observation and event roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvewise.operators import cleaning, traits
from curvewise.plans.base import CURVE, CURVE_SQL, LIFE, OBS, POP, life, obs, pop, query, rounded, table

WHO = ["id", "unit", "treatment"]


@query(
    "t01_clean",
    """
SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'O' ELSE o_orderstatus END AS status,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'fast' WHEN '2-HIGH' THEN 'fast'
            WHEN '3-MEDIUM' THEN 'slow' END AS regime
FROM orders WHERE o_orderpriority NOT IN ('5-LOW')""",
)
def t01(spark, d):
    od = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("regime")
    )
    return cleaning.clean_labels(
        od,
        drops={"regime": ["5-LOW"]},
        merges={"status": {"P": "O"}},
        recodes={"regime": {"1-URGENT": "fast", "2-HIGH": "fast", "3-MEDIUM": "slow"}},
    )


@query(
    "t02_output",
    f"""WITH {LIFE}
SELECT id, unit, treatment, CAST(sum(births) AS BIGINT) AS output,
       round(sum(births) / (CASE WHEN count(size_na) = count(*) THEN avg(size_na) END), 6) AS effort
FROM life WHERE stage = 'purchase' AND births >= 1 GROUP BY 1, 2, 3""",
)
def t02(spark, d):
    adult = life(spark, d).where("stage = 'purchase'")
    return rounded(traits.lifetime_output(adult, WHO, "births", "size_na"))


NET = """
nr AS (SELECT unit, treatment, stage, CASE WHEN size < 250 THEN size / 500 END AS lx, births AS mx FROM life)"""


@query(
    "t03_netrepro",
    f"""WITH {LIFE}, {NET}
SELECT unit, treatment, round(coalesce(sum(lx * mx), 0), 6) AS ro FROM nr
WHERE stage IN ('purchase', 'signup') GROUP BY 1, 2""",
)
def t03(spark, d):
    return rounded(
        traits.net_reproduction(
            _net(spark, d), ["unit", "treatment"], "stage", ["purchase", "signup"], "lx", "mx"
        )
    )


def _net(spark, d):
    share = F.when(F.col("size") < 250, F.col("size") / 500)
    return life(spark, d).withColumn("lx", share).withColumn("mx", F.col("births"))


@query(
    "t03_cumulative",
    f"""WITH {LIFE}, {NET}
SELECT unit, treatment, round(coalesce(sum(CASE WHEN stage = 'purchase' THEN lx * mx END), 0), 6) AS ro_purchase,
       round(coalesce(sum(CASE WHEN stage <> 'view' THEN lx * mx END), 0), 6) AS ro_signup,
       round(coalesce(sum(lx * mx), 0), 6) AS ro_view
FROM nr WHERE stage IN ('purchase', 'signup', 'view') GROUP BY 1, 2""",
)
def t03_cumulative(spark, d):
    return rounded(
        traits.net_reproduction(
            _net(spark, d), ["unit", "treatment"], "stage", ["purchase", "signup", "view"],
            "lx", "mx", cumulative=True,
        )
    )


@query(
    "t04_slope",
    f"""WITH {LIFE}
SELECT id, unit, treatment, round(regr_slope(ln(size), CAST(age AS DOUBLE)), 6) AS growth, count(size) AS n
FROM life WHERE stage <> 'error' GROUP BY 1, 2, 3""",
)
def t04(spark, d):
    return rounded(traits.growth_slope(life(spark, d).where("stage <> 'error'"), WHO, "age", "size"))


@query(
    "t05_endpoint",
    f"""WITH {LIFE}
SELECT id, unit, treatment, round(ln(arg_max(size, ts) / arg_min(size, ts)) / nullif(arg_max(age, ts), 0), 6) AS growth
FROM life GROUP BY 1, 2, 3""",
)
def t05(spark, d):
    return rounded(traits.growth_endpoint(life(spark, d), WHO, ["ts", "event_id"], "age", "size"))


@query(
    "t05_elapsed",
    f"""WITH {LIFE}
SELECT id, unit, treatment, round(ln(arg_max(size, ts) / arg_min(size, ts))
       / nullif(arg_max(age, ts) - arg_min(age, ts), 0), 6) AS growth
FROM life GROUP BY 1, 2, 3""",
)
def t05_elapsed(spark, d):
    return rounded(
        traits.growth_endpoint(life(spark, d), WHO, ["ts", "event_id"], "age", "size", elapsed=True)
    )


@query(
    "t06_score",
    "SELECT l_orderkey, round(max(10 * l_quantity + 100 * l_tax), 6) AS score FROM lineitem GROUP BY 1",
)
def t06(spark, d):
    li = table(spark, d, "lineitem")
    return rounded(traits.max_score(li, ["l_orderkey"], {"l_quantity": 10.0, "l_tax": 100.0}))


@query(
    "t07_stage",
    f"""WITH {LIFE}
SELECT unit, treatment, count(ln(size)) AS n, round(avg(ln(size)), 6) AS mean,
       round(stddev_samp(ln(size)) / sqrt(count(size)), 6) AS se
FROM life WHERE stage = 'signup' GROUP BY 1, 2""",
)
def t07(spark, d):
    df = life(spark, d).withColumn("log_size", F.log("size"))
    return rounded(traits.stage_means(df, "stage", "signup", ["unit", "treatment"], "log_size"))


@query(
    "t08_broods",
    f"""WITH {LIFE},
per AS (SELECT unit, treatment, id, avg(ln(size_na)) AS m, coalesce(sum(ln(size_na)), 0) AS s FROM life
        WHERE stage IN ('purchase', 'signup', 'view') GROUP BY 1, 2, 3)
SELECT unit, treatment, count(m) AS n_mean, round(avg(m), 6) AS mean_brood,
       round(stddev_samp(m) / sqrt(count(*)), 6) AS se_brood, count(s) AS n_total,
       round(avg(s), 6) AS mean_total, round(stddev_samp(s) / sqrt(count(*)), 6) AS se_total
FROM per GROUP BY 1, 2""",
)
def t08(spark, d):
    df = life(spark, d).withColumn("brood", F.log("size_na"))
    return rounded(
        traits.brood_summaries(
            df, "stage", ["purchase", "signup", "view"], ["id"], ["unit", "treatment"], "brood"
        )
    )


@query(
    "t09_frame",
    f"""WITH {POP}, kept AS (SELECT *, CASE WHEN balance > 0 THEN balance END AS bal FROM pop
                             WHERE unit NOT IN ('MACHINERY'))
SELECT id, concat_ws(':', unit, treatment, stage) AS factorial,
       round((y - (SELECT avg(y) FROM kept)) / (SELECT stddev_samp(y) FROM kept), 6) AS y_z
FROM kept WHERE bal IS NOT NULL""",
)
def t09(spark, d):
    df = pop(spark, d).withColumn("bal", F.when(F.col("balance") > 0, F.col("balance")))
    out = cleaning.analysis_frame(
        df, ["y"], ["unit", "treatment", "stage"], exclude={"unit": ["MACHINERY"]}
    )
    return rounded(out.select("id", "factorial", "y_z"))


@query(
    "t10_plasticity",
    f"""WITH {OBS}
SELECT unit, x, regime, round(avg(CASE WHEN treatment = 'F' THEN y END) - avg(CASE WHEN treatment = 'O' THEN y END), 6) AS delta,
       round(avg(CASE WHEN treatment = 'O' THEN ln(q) END), 6) AS mean_score
FROM obs GROUP BY unit, x, regime""",
)
def t10(spark, d):
    o = obs(spark, d).withColumn("score", F.log("q"))
    return rounded(traits.plasticity(o, ["unit", "x", "regime"], "treatment", "F", "O", "y", "score"))


@query(
    "t11_extremes",
    f"""WITH {OBS}
SELECT regime, x, round(regr_slope(y, ln(q)), 6) AS slope, count(*) AS n FROM obs WHERE x IN (0, 10) GROUP BY 1, 2""",
)
def t11(spark, d):
    ends = cleaning.extremes(obs(spark, d), "x", [0, 10])
    return rounded(
        ends.groupBy("regime", "x").agg(
            F.regr_slope("y", F.log("q")).alias("slope"), F.count(F.lit(1)).alias("n")
        )
    )


@query(
    "t12_tradeoff",
    f"""WITH {OBS}
SELECT {CURVE_SQL}, x, round(avg(ln(q)), 6) AS mean_score, round(avg(y_na), 6) AS mean_y_na
FROM obs GROUP BY {CURVE_SQL}, x""",
)
def t12(spark, d):
    o = obs(spark, d).withColumn("score", F.log("q"))
    return rounded(traits.tradeoff_table(o, [*CURVE, "x"], "score", "y_na"))
