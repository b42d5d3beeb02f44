"""Query registry and the observation roles of the driver tables.

OBS   one row per order line: unit = supplier, x = discount in percent, treatment =
      line status, regime = whether the line is still open, y = log price. `y_na`
      has missing values (lines with a quantity over 45), so that null rules count.
LIFE  one row per event of a user: individual = user, unit = nation, treatment =
      market segment, stage = event type, age = day number, size = value.
POP   one row per order: unit = market segment, treatment = status, y = log total.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CURVE = ["unit", "treatment", "regime"]
LOW, HIGH, POINTS = 0.0, 10.0, 41


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that summation order does not show in a value hash."""
    return df.select(
        *[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def long(c: Column) -> Column:
    return c.cast("bigint")


def obs(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    y = F.log("l_extendedprice")
    return li.select(
        F.col("l_suppkey").alias("unit"),
        F.round(F.col("l_discount") * 100).cast("int").alias("x"),
        F.col("l_linestatus").alias("treatment"),
        F.when(F.col("l_returnflag") == "N", "open").otherwise("settled").alias("regime"),
        y.alias("y"),
        F.when(F.col("l_quantity") <= 45, y).alias("y_na"),
        F.col("l_quantity").alias("q"),
    )


OBS = """obs AS (
  SELECT l_suppkey AS unit, CAST(round(l_discount * 100) AS INT) AS x, l_linestatus AS treatment,
         CASE WHEN l_returnflag = 'N' THEN 'open' ELSE 'settled' END AS regime,
         ln(l_extendedprice) AS y,
         CASE WHEN l_quantity <= 45 THEN ln(l_extendedprice) END AS y_na,
         l_quantity AS q
  FROM lineitem)"""


def life(spark: SparkSession, folder: str) -> DataFrame:
    ev, cu = table(spark, folder, "events"), table(spark, folder, "customer")
    return ev.join(cu, F.col("user_id") == F.col("c_custkey")).select(
        F.col("user_id").alias("id"),
        F.col("c_nationkey").alias("unit"),
        F.col("c_mktsegment").alias("treatment"),
        F.col("event_type").alias("stage"),
        (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).alias("age"),
        F.col("value").alias("size"),
        F.floor(F.col("value") / 25).cast("int").alias("births"),
        F.when(F.col("value") < 400, F.col("value")).alias("size_na"),
        "ts",
        "event_id",
    )


LIFE = """life AS (
  SELECT user_id AS id, c_nationkey AS unit, c_mktsegment AS treatment, event_type AS stage,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INT) AS age,
         value AS size, CAST(floor(value / 25) AS INT) AS births,
         CASE WHEN value < 400 THEN value END AS size_na, ts, event_id
  FROM events JOIN customer ON user_id = c_custkey)"""


def pop(spark: SparkSession, folder: str) -> DataFrame:
    od, cu = table(spark, folder, "orders"), table(spark, folder, "customer")
    return od.join(cu, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("unit"),
        F.col("o_orderstatus").alias("treatment"),
        F.col("o_orderpriority").alias("stage"),
        F.month("o_orderdate").alias("x"),
        F.log("o_totalprice").alias("y"),
        F.col("o_orderkey").alias("id"),
        F.col("c_acctbal").alias("balance"),
    )


POP = """pop AS (
  SELECT c_mktsegment AS unit, o_orderstatus AS treatment, o_orderpriority AS stage,
         CAST(month(o_orderdate) AS INT) AS x, ln(o_totalprice) AS y, o_orderkey AS id,
         c_acctbal AS balance
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _determinant(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    if len(m) == 2:
        return f"({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[1][0]})"
    minors = [[[row[c] for c in range(3) if c != k] for row in m[1:]] for k in range(3)]
    a, b, c = (f"{m[0][k]} * {_determinant(minors[k])}" for k in range(3))
    return f"({a} - {b} + {c})"


def solve_sql(p: int, s: str = "s", r: str = "r", tolerance: str = "1e-11") -> tuple[str, list[str]]:
    """Guarded determinant and solutions (over a column `det`) of a symmetric system."""
    at = lambda i, j: f"{s}{min(i, j)}{max(i, j)}"
    full = [[at(i, j) for j in range(p)] for i in range(p)]
    det = _determinant(full)
    scale = " * ".join(at(i, i) for i in range(p))
    guarded = f"CASE WHEN {det} > {tolerance} * {scale} THEN {det} END"
    solutions = []
    for k in range(p):
        m = [[f"{r}{i}" if j == k else full[i][j] for j in range(p)] for i in range(p)]
        solutions.append(f"{_determinant(m)} / det")
    return guarded, solutions


def design_sql(keys: str, terms: list[str], source: str = "obs", y: str = "y", name: str = "q") -> str:
    """CTEs of the per-key regression of y on up to three terms, as `name`."""
    p = len(terms)
    t = ", ".join(f"CAST({e} AS DOUBLE) AS t{i}" for i, e in enumerate(terms))
    aggs = ["count(*) AS n", "avg(yv) AS my", "var_samp(yv) AS yy"]
    for i in range(p):
        aggs += [f"avg(t{i}) AS m{i}", f"covar_samp(t{i}, yv) AS r{i}", f"var_samp(t{i}) AS s{i}{i}"]
        aggs += [f"covar_samp(t{i}, t{j}) AS s{i}{j}" for j in range(i + 1, p)]
    complete = " AND ".join(["yv IS NOT NULL"] + [f"t{i} IS NOT NULL" for i in range(p)])
    det, solutions = solve_sql(p)
    slopes = ", ".join(f"{e} AS b{i + 1}" for i, e in enumerate(solutions))
    level = " - ".join(["my"] + [f"b{i + 1} * m{i}" for i in range(p)])
    explained = " + ".join(f"b{i + 1} * r{i}" for i in range(p))
    b = ", ".join(f"b{i + 1}" for i in range(p))
    return f"""{name}_m AS (
  SELECT {keys}, {", ".join(aggs)} FROM (SELECT {keys}, {y} AS yv, {t} FROM {source})
  WHERE {complete} GROUP BY {keys}),
{name}_b AS (SELECT *, {slopes} FROM (SELECT *, {det} AS det FROM {name}_m)),
{name} AS (
  SELECT {keys}, n, {level} AS b0, {b},
         CASE WHEN b1 IS NOT NULL THEN greatest((n - 1) * (yy - ({explained})), CAST(0 AS DOUBLE)) END AS sse,
         (n - 1) * yy AS sst, ({explained}) / nullif(yy, 0) AS r2
  FROM {name}_b)"""


def quadratic_sql(keys: str, source: str = "obs", y: str = "y", name: str = "q") -> str:
    return design_sql(keys, ["x", "CAST(x AS DOUBLE) * x"], source, y, name)


CURVE_SQL = "unit, treatment, regime"
GRID = "grid AS (SELECT CAST(i AS DOUBLE) * 0.25 AS x FROM range(41) t(i))"
PTS = f"""{OBS},
{quadratic_sql(CURVE_SQL)},
{GRID},
pts AS MATERIALIZED (
  SELECT unit, treatment, regime, grid.x AS x, (b2 * grid.x + b1) * grid.x + b0 AS fit
  FROM q CROSS JOIN grid WHERE b2 IS NOT NULL)"""
