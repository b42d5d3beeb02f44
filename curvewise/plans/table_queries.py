"""Scans, projections, recoding, joins and reshaping (S, C, J, R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvewise.functions import columns as C
from curvewise.operators import cleaning, inspecting, joining, reshaping
from curvewise.operators.curves import curve_peak
from curvewise.operators.fitting import curve_points, fitted, grouped_poly
from curvewise.plans.base import (
    CURVE,
    CURVE_SQL,
    GRID,
    HIGH,
    LIFE,
    LOW,
    OBS,
    POINTS,
    PTS,
    life,
    obs,
    quadratic_sql,
    query,
    rounded,
    table,
)

LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


@query("s03_scan", "SELECT * FROM customer")
def s03(spark, d):
    return table(spark, d, "customer")


@query(
    "s05_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS n_null, "
        f"count(DISTINCT {c}) AS n_distinct FROM lineitem"
        for c in LINE_COLUMNS
    ),
)
def s05(spark, d):
    return inspecting.profile(table(spark, d, "lineitem")).drop("type")


@query(
    "s06_levels",
    """
SELECT 'l_returnflag' AS "column", l_returnflag AS level, count(*) AS n FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2""",
)
def s06(spark, d):
    return inspecting.level_audit(
        table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]
    )


@query("s07_frequencies", "SELECT event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY 1")
def s07(spark, d):
    return inspecting.frequencies(table(spark, d, "events").where("value > 10"), "event_type")


@query("c01_select", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def c01(spark, d):
    return table(spark, d, "orders").drop("o_orderdate", "o_orderpriority")


@query("c02_rename", "SELECT p_partkey AS id, p_brand AS unit, p_size AS x, p_retailprice AS y FROM part")
def c02(spark, d):
    names = {"p_partkey": "id", "p_brand": "unit", "p_size": "x", "p_retailprice": "y"}
    return table(spark, d, "part").select(*names).withColumnsRenamed(names)


@query(
    "c03_filter",
    """
SELECT l_orderkey, l_partkey, l_quantity, l_returnflag, l_linestatus FROM lineitem
WHERE l_quantity < 24 AND (l_returnflag = 'R' OR l_linestatus <> 'O') AND l_extendedprice > 1000""",
)
def c03(spark, d):
    li = table(spark, d, "lineitem")
    return li.where(
        (F.col("l_quantity") < 24)
        & ((F.col("l_returnflag") == "R") | (F.col("l_linestatus") != "O"))
        & (F.col("l_extendedprice") > 1000)
    ).select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")


@query(
    "c04_members",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')",
)
def c04(spark, d):
    od = table(spark, d, "orders")
    return od.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW")).select(
        "o_orderkey", "o_orderpriority"
    )


@query("c05_nonnull", f"WITH {OBS} SELECT unit, x, round(y_na, 6) AS y_na FROM obs WHERE y_na IS NOT NULL")
def c05(spark, d):
    return rounded(obs(spark, d).where(F.col("y_na").isNotNull()).select("unit", "x", "y_na"))


@query(
    "c06_complete",
    f"""WITH {OBS} SELECT unit, x, treatment, regime, round(y_na, 6) AS y_na, q FROM obs
WHERE unit IS NOT NULL AND x IS NOT NULL AND treatment IS NOT NULL AND regime IS NOT NULL
  AND y_na IS NOT NULL AND q IS NOT NULL""",
)
def c06(spark, d):
    return rounded(cleaning.complete_cases(obs(spark, d).drop("y")))


@query(
    "c07_cast",
    """
SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority
                                 ELSE substr(o_orderpriority, 1, 1) END AS INT) AS priority
FROM orders""",
)
def c07(spark, d):
    text = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(
        F.substring("o_orderpriority", 1, 1)
    )
    return table(spark, d, "orders").select("o_orderkey", text.try_cast("int").alias("priority"))


@query(
    "c08_derived",
    """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS revenue,
       round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge
FROM lineitem""",
)
def c08(spark, d):
    li = table(spark, d, "lineitem")
    out = li.withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    out = out.withColumn("charge", F.col("revenue") * (1 + F.col("l_tax")))
    return rounded(out.select("l_orderkey", "l_linenumber", "revenue", "charge"))


@query(
    "c09_recode",
    """
SELECT event_id, CASE event_type WHEN 'purchase' THEN 'B1' WHEN 'signup' THEN 'B2'
                                 WHEN 'view' THEN 'B3' END AS stage FROM events""",
)
def c09(spark, d):
    mapping = {"purchase": "B1", "signup": "B2", "view": "B3"}
    return table(spark, d, "events").select(
        "event_id", C.recode(F.col("event_type"), mapping).alias("stage")
    )


@query(
    "c10_relabel",
    """
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'visit' ELSE event_type END AS stage
FROM events""",
)
def c10(spark, d):
    return table(spark, d, "events").select(
        "event_id", C.relabel(F.col("event_type"), {"click": "visit", "view": "visit"}).alias("stage")
    )


KEYED = """
SELECT concat_ws('-', l_returnflag, coalesce(CASE WHEN l_quantity <= 45 THEN l_linestatus END, 'NA'),
                 CAST(l_linenumber AS VARCHAR)) AS key FROM lineitem"""


def _keyed(spark, d):
    li = table(spark, d, "lineitem")
    status = F.when(F.col("l_quantity") <= 45, F.col("l_linestatus"))
    return li.select(
        C.composite_key([F.col("l_returnflag"), status, F.col("l_linenumber")], "-").alias("key")
    )


@query("c11_key", f"SELECT key, count(*) AS n FROM ({KEYED}) GROUP BY key")
def c11(spark, d):
    return inspecting.frequencies(_keyed(spark, d), "key")


@query(
    "c12_split",
    f"""
SELECT split_part(key, '-', 1) AS flag, split_part(key, '-', 2) AS status,
       split_part(key, '-', 3) AS line, count(*) AS n FROM ({KEYED}) GROUP BY 1, 2, 3""",
)
def c12(spark, d):
    parts = _keyed(spark, d).select(*C.split_key(F.col("key"), ["flag", "status", "line"], "-"))
    return parts.groupBy("flag", "status", "line").agg(F.count(F.lit(1)).alias("n"))


@query("c13_distinct", f"WITH {OBS} SELECT DISTINCT treatment, regime, x FROM obs")
def c13(spark, d):
    return obs(spark, d).select("treatment", "regime", "x").distinct()


@query(
    "c14_levels",
    """
SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2
  WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 END AS INT) AS level FROM orders""",
)
def c14(spark, d):
    levels = ["5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    return table(spark, d, "orders").select(
        "o_orderkey", C.level_rank(F.col("o_orderpriority"), levels).alias("level")
    )


@query(
    "c15_flag",
    f"WITH {LIFE} SELECT event_id, age = 1 AS first_day FROM life WHERE age = 1 OR stage = 'purchase'",
)
def c15(spark, d):
    df = life(spark, d).where((F.col("age") == 1) | (F.col("stage") == "purchase"))
    return df.select("event_id", (F.col("age") == 1).alias("first_day"))


@query(
    "c16_math",
    """
SELECT event_id, round(ln(value), 6) AS log_value, round(exp(-value / 100), 6) AS decay,
       round(sqrt(value), 6) AS root, round(abs(value - 50), 6) AS gap,
       round(power(value / 100, 1.5), 6) AS power
FROM events""",
)
def c16(spark, d):
    v = F.col("value")
    return rounded(
        table(spark, d, "events").select(
            "event_id",
            F.log(v).alias("log_value"),
            F.exp(-v / 100).alias("decay"),
            F.sqrt(v).alias("root"),
            F.abs(v - 50).alias("gap"),
            F.pow(v / 100, F.lit(1.5)).alias("power"),
        )
    )


@query(
    "c17_grid",
    f"""WITH {OBS} SELECT unit, round(lo + i * ((hi - lo) / 99), 6) AS x
FROM (SELECT unit, CAST(min(q) AS DOUBLE) AS lo, CAST(max(q) AS DOUBLE) AS hi FROM obs GROUP BY unit)
CROSS JOIN range(100) t(i)""",
)
def c17(spark, d):
    spans = obs(spark, d).groupBy("unit").agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    points = joining.points_between(F.col("lo"), F.col("hi"), 100)
    return rounded(spans.select("unit", F.explode(points).alias("x")))


@query(
    "c18_logmean",
    """
SELECT l_suppkey, round(ln(avg(l_extendedprice)), 6) AS log_mean FROM lineitem GROUP BY l_suppkey""",
)
def c18(spark, d):
    li = table(spark, d, "lineitem")
    return rounded(li.groupBy("l_suppkey").agg(F.log(F.avg("l_extendedprice")).alias("log_mean")))


# --- joins -----------------------------------------------------------------


@query(
    "j01_left",
    f"""WITH {OBS},
a AS (SELECT unit, q, x, avg(y) AS mean_y FROM obs WHERE treatment = 'F' GROUP BY unit, q, x),
b AS (SELECT unit, q, x, avg(y_na) AS mean_y_na FROM obs WHERE treatment = 'O' GROUP BY unit, q, x)
SELECT unit, q, x, round(mean_y, 6) AS mean_y, round(mean_y_na, 6) AS mean_y_na
FROM a LEFT JOIN b USING (unit, q, x)""",
)
def j01(spark, d):
    o, keys = obs(spark, d), ["unit", "q", "x"]
    a = o.where("treatment = 'F'").groupBy(*keys).agg(F.avg("y").alias("mean_y"))
    b = o.where("treatment = 'O'").groupBy(*keys).agg(F.avg("y_na").alias("mean_y_na"))
    return rounded(joining.natural_join(a, b, "left"))


J02_SIDES = """
a AS (SELECT CASE WHEN l_quantity <= 45 THEN l_partkey END AS part, l_linenumber AS line,
             sum(l_quantity) AS sum_a FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
b AS (SELECT CASE WHEN l_quantity <= 45 THEN l_partkey END AS part, l_linenumber AS line,
             sum(l_quantity) AS sum_b FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)"""


@query(
    "j02_full",
    f"""WITH {J02_SIDES}
SELECT coalesce(a.part, b.part) AS part, coalesce(a.line, b.line) AS line, sum_a, sum_b
FROM a FULL JOIN b ON a.part IS NOT DISTINCT FROM b.part AND a.line = b.line""",
)
def j02(spark, d):
    li = table(spark, d, "lineitem")
    part = F.when(F.col("l_quantity") <= 45, F.col("l_partkey")).alias("part")

    def side(status, name):
        rows = li.where(F.col("l_linestatus") == status)
        keys = [part, F.col("l_linenumber").alias("line")]
        return rows.groupBy(*keys).agg(F.sum("l_quantity").alias(name))

    return joining.natural_join(side("F", "sum_a"), side("O", "sum_b"), "full", null_safe=True)


@query(
    "j02_pairs",
    """
WITH a AS (SELECT l_partkey AS part, l_discount AS x, ln(l_extendedprice) AS ya FROM lineitem
           WHERE l_linestatus = 'F'),
b AS (SELECT l_partkey AS part, l_discount AS x, CASE WHEN l_quantity <= 45 THEN l_quantity END AS yb
      FROM lineitem WHERE l_linestatus = 'O')
SELECT part, x, round(avg(ya), 6) AS mean_ya, round(avg(yb), 6) AS mean_yb, count(*) AS n_rows
FROM a FULL JOIN b USING (part, x) GROUP BY part, x""",
)
def j02_pairs(spark, d):
    li = table(spark, d, "lineitem")
    keys = [F.col("l_partkey").alias("part"), F.col("l_discount").alias("x")]
    a = li.where("l_linestatus = 'F'").select(*keys, F.log("l_extendedprice").alias("ya"))
    b = li.where("l_linestatus = 'O'").select(
        *keys, F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("yb")
    )
    out = joining.paired_rows_summary(a, b, ["part", "x"], "ya", "yb")
    return rounded(out.select("part", "x", "mean_ya", "mean_yb", "n_rows"))


@query(
    "j03_suffix",
    f"""WITH {OBS},
a AS (SELECT unit, q, x, avg(y) AS m, count(*) AS n FROM obs WHERE treatment = 'F' GROUP BY 1, 2, 3),
b AS (SELECT unit, q, x, avg(y) AS m, count(*) AS n FROM obs WHERE treatment = 'O' GROUP BY 1, 2, 3)
SELECT unit, q, x, round(a.m, 6) AS m_x, round(b.m, 6) AS m_y, a.n AS n_x, b.n AS n_y
FROM a FULL JOIN b USING (unit, q, x)""",
)
def j03(spark, d):
    o, keys = obs(spark, d), ["unit", "q", "x"]

    def side(level):
        rows = o.where(F.col("treatment") == level).groupBy(*keys)
        return rows.agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n"))

    return rounded(joining.join_suffix(side("F"), side("O"), keys))


@query(
    "j04_grid",
    f"""WITH {OBS}, {GRID}
SELECT u.unit, t.treatment, r.regime, grid.x FROM (SELECT DISTINCT unit FROM obs) u
CROSS JOIN (SELECT DISTINCT treatment FROM obs) t CROSS JOIN (SELECT DISTINCT regime FROM obs) r
CROSS JOIN grid""",
)
def j04(spark, d):
    return joining.prediction_grid(
        obs(spark, d), "unit", ["treatment", "regime"], "x", LOW, HIGH, POINTS
    )


@query(
    "j05_predict",
    f"""WITH {OBS}, {quadratic_sql("treatment, regime")}, {GRID}
SELECT u.unit, q.treatment, q.regime, grid.x, round((b2 * grid.x + b1) * grid.x + b0, 6) AS fit
FROM (SELECT DISTINCT unit FROM obs) u CROSS JOIN q CROSS JOIN grid""",
)
def j05(spark, d):
    o = obs(spark, d)
    grid = joining.prediction_grid(o, "unit", ["treatment", "regime"], "x", LOW, HIGH, POINTS)
    coefs = grouped_poly(o, ["treatment", "regime"], "x", "y").select(
        "treatment", "regime", "b0", "b1", "b2"
    )
    points = joining.natural_join(grid, coefs, "left", null_safe=True)
    return rounded(points.select("unit", "treatment", "regime", "x", fitted(F.col("x"), 2).alias("fit")))


@query(
    "j06_traitpair",
    """
WITH a AS (SELECT l_suppkey AS unit, l_returnflag AS regime, avg(ln(l_extendedprice)) AS mean_price,
                  count(*) AS n_a FROM lineitem GROUP BY 1, 2),
b AS (SELECT s_suppkey AS unit, 'A' AS regime, avg(s_acctbal) AS mean_s_acctbal, count(*) AS n_b
      FROM supplier GROUP BY 1)
SELECT unit, regime, round(mean_price, 6) AS mean_price, round(mean_s_acctbal, 6) AS mean_s_acctbal,
       n_a, n_b FROM a FULL JOIN b USING (unit, regime)""",
)
def j06(spark, d):
    a = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("unit"),
        F.col("l_returnflag").alias("regime"),
        F.log("l_extendedprice").alias("price"),
    )
    b = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("unit"), F.lit("A").alias("regime"), "s_acctbal"
    )
    out = joining.trait_pair(a, b, ["unit", "regime"], "price", "s_acctbal")
    return rounded(out.select("unit", "regime", "mean_price", "mean_s_acctbal", "n_a", "n_b"))


# --- reshaping -------------------------------------------------------------


@query(
    "r01_union",
    f"""WITH {PTS},
top AS (SELECT *, max(fit) OVER (PARTITION BY {CURVE_SQL}) AS best FROM pts)
SELECT {CURVE_SQL}, x, round(fit, 6) AS fit, 'Opt' AS metric FROM top WHERE fit = best
UNION ALL SELECT {CURVE_SQL}, x, round(fit, 6), 'Min' FROM pts WHERE x = 0
UNION ALL SELECT {CURVE_SQL}, NULL, round(fit, 6), 'Max' FROM pts WHERE x = 10""",
)
def r01(spark, d):
    pts = curve_points(
        grouped_poly(obs(spark, d), CURVE, "x", "y"), CURVE, joining.sequence_points(LOW, HIGH, POINTS)
    )
    best = curve_peak(pts, CURVE).select(*CURVE, F.col("topt").alias("x"), F.col("popt").alias("fit"))
    parts = {
        "Opt": best,
        "Min": pts.where("x = 0"),
        "Max": pts.where("x = 10").drop("x"),  # a missing column is filled with null
    }
    return rounded(reshaping.labelled_union(parts))


@query(
    "r02_long",
    """
SELECT l_orderkey, l_linenumber, measure, value FROM (
  SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
UNPIVOT (value FOR measure IN (l_quantity, l_discount, l_tax))""",
)
def r02(spark, d):
    return reshaping.to_long(
        table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"]
    )


@query(
    "r03_wide",
    f"""WITH {OBS}, c AS (SELECT {CURVE_SQL}, x, avg(y) AS m FROM obs GROUP BY {CURVE_SQL}, x)
SELECT {CURVE_SQL}, round(max(CASE WHEN x = 0 THEN m END), 6) AS at_low,
       round(max(CASE WHEN x = 10 THEN m END), 6) AS at_high FROM c GROUP BY {CURVE_SQL}""",
)
def r03(spark, d):
    cells = obs(spark, d).groupBy(*CURVE, "x").agg(F.avg("y").alias("m"))
    return rounded(reshaping.to_wide(cells, CURVE, "x", {0: "at_low", 10: "at_high"}, "m"))


@query(
    "r04_nest",
    """
SELECT l_suppkey, l_returnflag, count(*) AS n_rows, min(l_partkey) AS first_part,
       max(l_partkey) AS last_part, CAST(sum(l_quantity) AS BIGINT) AS total
FROM lineitem GROUP BY 1, 2""",
)
def r04(spark, d):
    keys = ["l_suppkey", "l_returnflag"]
    li = table(spark, d, "lineitem").select(*keys, "l_partkey", F.col("l_quantity").cast("int").alias("qty"))
    nested = reshaping.nest(li, keys, max_rows=50)
    totals = F.aggregate("data", F.lit(0).cast("bigint"), lambda a, r: a + r["qty"] * r["copies"])
    per_chunk = nested.select(
        *keys, "n_rows", F.col("data")[0]["l_partkey"].alias("lo"),
        F.element_at("data", -1)["l_partkey"].alias("hi"), totals.alias("t"),
    )
    return per_chunk.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), F.min("lo").alias("first_part"),
        F.max("hi").alias("last_part"), F.sum("t").alias("total"),
    )


@query(
    "r04_unnest",
    "SELECT l_suppkey, l_returnflag, l_partkey, l_quantity FROM lineitem",
)
def r04_unnest(spark, d):
    keys = ["l_suppkey", "l_returnflag"]
    li = table(spark, d, "lineitem").select(*keys, "l_partkey", "l_quantity")
    return reshaping.unnest(reshaping.nest(li, keys), keys)
