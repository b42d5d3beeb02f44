"""Aggregates, standard errors, order-based picks (A, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvewise.functions import columns as C
from curvewise.operators import cleaning, curves, ordering, summarising
from curvewise.operators.fitting import curve_points, grouped_poly
from curvewise.operators.joining import sequence_points
from curvewise.plans.base import (
    CURVE,
    CURVE_SQL,
    HIGH,
    LIFE,
    LOW,
    OBS,
    POINTS,
    PTS,
    life,
    obs,
    query,
    rounded,
    table,
)

CELL = [*CURVE, "x"]
CELL_SQL = f"{CURVE_SQL}, x"


@query(
    "a01_means",
    f"WITH {OBS} SELECT {CELL_SQL}, round(avg(y_na), 6) AS mean_y_na, round(avg(ln(q)), 6) AS mean_log_q"
    f" FROM obs GROUP BY {CELL_SQL}",
)
def a01(spark, d):
    o = obs(spark, d).withColumn("log_q", F.log("q"))
    return rounded(summarising.cell_means(o, CELL, ["y_na", "log_q"]))


def _se(rule: str) -> str:
    return f"""WITH {OBS}
SELECT {CELL_SQL}, count(y_na) AS n, round(avg(y_na), 6) AS mean,
       round(stddev_samp(y_na) / sqrt({rule}), 6) AS se FROM obs GROUP BY {CELL_SQL}"""


@query("a02_se", _se("count(y_na)"))
def a02(spark, d):
    return rounded(summarising.mean_se(obs(spark, d), CELL, "y_na"))


@query("a03_serows", _se("count(*)"))
def a03(spark, d):
    return rounded(summarising.mean_se(obs(spark, d), CELL, "y_na", n="rows"))


@query(
    "a03_strict",
    f"""WITH {OBS}
SELECT {CELL_SQL}, round(CASE WHEN count(y_na) = count(*) THEN avg(y_na) END, 6) AS mean,
       round(CASE WHEN count(y_na) = count(*) THEN stddev_samp(y_na) / sqrt(count(*)) END, 6) AS se
FROM obs GROUP BY {CELL_SQL}""",
)
def a03_strict(spark, d):
    y = F.col("y_na")
    return rounded(
        obs(spark, d).groupBy(*CELL).agg(
            C.strict_mean(y).alias("mean"), C.sqrt_scaled_error(y).alias("se")
        )
    )


@query("a04_sefixed", _se("10"))
def a04(spark, d):
    return rounded(summarising.mean_se(obs(spark, d), CELL, "y_na", n=10))


@query(
    "a05_nested",
    f"""WITH {LIFE},
per AS (SELECT unit, treatment, stage, id, avg(ln(size_na)) AS m FROM life GROUP BY 1, 2, 3, 4)
SELECT unit, treatment, stage, count(m) AS n, round(avg(m), 6) AS mean,
       round(stddev_samp(m) / sqrt(count(*)), 6) AS se FROM per GROUP BY 1, 2, 3""",
)
def a05(spark, d):
    df = life(spark, d).withColumn("m", F.log("size_na"))
    return rounded(summarising.nested_mean_se(df, ["id"], ["unit", "treatment", "stage"], "m"))


@query(
    "a06_totals",
    f"""WITH {LIFE},
per AS (SELECT unit, treatment, stage, id, coalesce(sum(ln(size_na)), 0) AS m FROM life GROUP BY 1, 2, 3, 4)
SELECT unit, treatment, stage, count(m) AS n, round(avg(m), 6) AS mean,
       round(stddev_samp(m) / sqrt(count(*)), 6) AS se FROM per GROUP BY 1, 2, 3""",
)
def a06(spark, d):
    df = life(spark, d).withColumn("m", F.log("size_na"))
    return rounded(summarising.nested_total_mean_se(df, ["id"], ["unit", "treatment", "stage"], "m"))


@query("a07_counts", f"WITH {OBS} SELECT {CELL_SQL}, count(*) AS n FROM obs GROUP BY {CELL_SQL}")
def a07(spark, d):
    return summarising.cell_counts(obs(spark, d), CELL)


@query(
    "a08_replicates",
    f"WITH {OBS} SELECT {CELL_SQL}, count(y_na) AS n FROM obs GROUP BY {CELL_SQL} HAVING count(y_na) = 3",
)
def a08(spark, d):
    return summarising.replicate_audit(obs(spark, d), CELL, "y_na", 3)


@query(
    "a09_max",
    "SELECT l_orderkey, max(l_quantity) AS max_quantity FROM lineitem GROUP BY l_orderkey",
)
def a09(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(F.max("l_quantity").alias("max_quantity"))


@query(
    "a10_template",
    f"""WITH {PTS},
t AS (SELECT {CURVE_SQL}, max(CASE WHEN x = 0 THEN fit END) AS lo, max(CASE WHEN x = 10 THEN fit END) AS hi,
             arg_max(x, fit) AS topt, max(fit) AS popt FROM pts GROUP BY {CURVE_SQL})
SELECT treatment, regime, round(avg(lo), 6) AS mean_lo, round(avg(hi), 6) AS mean_hi,
       round(avg(topt), 6) AS mean_topt, round(avg(popt), 6) AS mean_popt FROM t GROUP BY 1, 2""",
)
def a10(spark, d):
    pts = curve_points(
        grouped_poly(obs(spark, d), CURVE, "x", "y"), CURVE, sequence_points(LOW, HIGH, POINTS)
    )
    traits = curves.four_traits(pts, CURVE, {0.0: "lo", 10.0: "hi"})
    return rounded(summarising.cell_means(traits, ["treatment", "regime"], ["lo", "hi", "topt", "popt"]))


@query(
    "a11_contrast",
    f"""WITH {OBS}, c AS (SELECT {CELL_SQL}, avg(y) AS y, avg(ln(q)) AS lq FROM obs GROUP BY {CELL_SQL})
SELECT unit, regime, x,
       round(max(CASE WHEN treatment = 'O' THEN y END) - max(CASE WHEN treatment = 'F' THEN y END), 6) AS delta_y,
       round(max(CASE WHEN treatment = 'O' THEN lq END) - max(CASE WHEN treatment = 'F' THEN lq END), 6) AS delta_lq
FROM c GROUP BY unit, regime, x""",
)
def a11(spark, d):
    cells = obs(spark, d).groupBy(*CELL).agg(F.avg("y").alias("y"), F.avg(F.log("q")).alias("lq"))
    return rounded(
        summarising.paired_contrast(cells, ["unit", "regime", "x"], "treatment", "F", "O", ["y", "lq"])
    )


@query(
    "a12_zscore",
    f"""WITH {OBS}
SELECT unit, x, q, round((y_na - (SELECT avg(y_na) FROM obs)) / (SELECT stddev_samp(y_na) FROM obs), 6) AS y_na_z,
       round((q - (SELECT avg(q) FROM obs)) / (SELECT stddev_samp(q) FROM obs), 6) AS q_z FROM obs""",
)
def a12(spark, d):
    o = obs(spark, d).select("unit", "x", "q", "y_na")
    return rounded(cleaning.standardize(o, ["y_na", "q"]).drop("y_na"))


@query(
    "a12_zscorekeys",
    f"""WITH {OBS},
s AS (SELECT unit, avg(y_na) AS m, stddev_samp(y_na) AS sd FROM obs GROUP BY unit)
SELECT unit, x, q, round((y_na - m) / sd, 6) AS y_na_z FROM obs JOIN s USING (unit)""",
)
def a12_keys(spark, d):
    o = obs(spark, d).select("unit", "x", "q", "y_na")
    return rounded(cleaning.standardize(o, ["y_na"], keys=["unit"]).drop("y_na"))


@query(
    "a13_median",
    f"WITH {OBS} SELECT unit, round(quantile_cont(y_na, 0.5), 6) AS median FROM obs"
    " WHERE y_na IS NOT NULL GROUP BY unit",
)
def a13(spark, d):
    return rounded(ordering.rank_groups_by_median(obs(spark, d), "unit", "y_na"))


BOX_SQL = """h AS (SELECT {k}, quantile_cont({y}, 0.25) AS q1, quantile_cont({y}, 0.5) AS median,
               quantile_cont({y}, 0.75) AS q3 FROM {t} WHERE {y} IS NOT NULL GROUP BY {k}),
box AS (SELECT {k}, count(*) AS n, round(min(q1), 6) AS q1, round(min(median), 6) AS median, round(min(q3), 6) AS q3,
       round(min(CASE WHEN ok THEN {y} END), 6) AS whisker_low,
       round(max(CASE WHEN ok THEN {y} END), 6) AS whisker_high,
       CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM (SELECT *, {y} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok
      FROM {t} JOIN h USING ({k}) WHERE {y} IS NOT NULL) GROUP BY {k})"""


@query(
    "a14_box",
    f"WITH {OBS}, " + BOX_SQL.format(k="unit, regime", y="y_na", t="obs") + " SELECT * FROM box",
)
def a14(spark, d):
    return rounded(ordering.box_stats(obs(spark, d), ["unit", "regime"], "y_na"))


@query(
    "a15_interval",
    f"""WITH {OBS},
s AS (SELECT {CELL_SQL}, count(y_na) AS n, avg(y_na) AS mean, stddev_samp(y_na) / sqrt(count(y_na)) AS se
      FROM obs GROUP BY {CELL_SQL})
SELECT {CELL_SQL}, n, round(mean, 6) AS mean, round(se, 6) AS se,
       round(mean - CAST(1.96 AS DOUBLE) * se, 6) AS lower, round(mean + CAST(1.96 AS DOUBLE) * se, 6) AS upper
FROM s""",
)
def a15(spark, d):
    return rounded(
        summarising.interval_columns(summarising.mean_se(obs(spark, d), CELL, "y_na"), z=1.96)
    )


# --- order -----------------------------------------------------------------


@query(
    "w01_argmax",
    """
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem
QUALIFY l_quantity = max(l_quantity) OVER (PARTITION BY l_orderkey)""",
)
def w01(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return ordering.argmax_rows(li, ["l_orderkey"], "l_quantity")


@query(
    "w02_topn",
    """
SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM lineitem
QUALIFY rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) <= 3""",
)
def w02(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return ordering.top_n(li, ["l_suppkey"], "l_quantity", 3)


@query(
    "w03_firstlast",
    """
SELECT event_id, user_id, first_value(value) OVER w AS first_value, last_value(value) OVER w AS last_value
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def w03(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    out = ordering.first_last(ev, ["user_id"], ["ts", "event_id"], ["value"])
    return out.select("event_id", "user_id", "first_value", "last_value")


@query(
    "w04_grouprows",
    """
SELECT event_id, user_id, max(value) OVER w AS top, count(*) OVER w AS n FROM events
WINDOW w AS (PARTITION BY user_id)""",
)
def w04(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "value")
    out = ordering.group_values(ev, ["user_id"], top=F.max("value"), n=F.count(F.lit(1)))
    return out.drop("value")


@query(
    "w05_difference",
    f"""WITH {OBS}, c AS (SELECT unit, q, avg(y) AS y FROM obs GROUP BY unit, q)
SELECT unit, q, round(y, 6) AS y, round(y - lag(y) OVER (PARTITION BY unit ORDER BY q), 6) AS diff FROM c""",
)
def w05(spark, d):
    means = obs(spark, d).groupBy("unit", "q").agg(F.avg("y").alias("y"))
    return rounded(ordering.differences(means, ["unit"], "q", "y"))


@query(
    "w05_segmented",
    """
SELECT user_id, event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts), 6) AS diff
FROM events""",
)
def w05_segmented(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    out = ordering.differences(ev.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))),
                               ["user_id"], "at", "value", segments=8)
    return rounded(out.select("user_id", "event_id", "diff"))


@query(
    "w06_nearest",
    """
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(l_extendedprice - 50000), l_orderkey,
                           l_linenumber, l_partkey) = 1""",
)
def w06(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
    )
    return ordering.nearest_row(
        li, ["l_suppkey"], "l_extendedprice", 50000, ["l_orderkey", "l_linenumber", "l_partkey"]
    )


@query(
    "w07_order",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey",
)
def w07(spark, d):
    od = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return od.orderBy("o_orderstatus", F.col("o_totalprice").desc(), "o_orderkey")


@query(
    "w08_head",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
)
def w08(spark, d):
    od = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return od.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)
