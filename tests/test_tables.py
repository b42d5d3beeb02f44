"""Sources, cleaning, null rules, joins and reshaping on small literals."""

import math

import pytest
from pyspark.sql import functions as F

from curvewise.functions import columns as C
from curvewise.operators import cleaning, inspecting, joining, reshaping, summarising, traits
from curvewise.sources import read_observations, write_table

RAW = (
    "ID,Clone,Temperature,Mean.Rep,Stage\r"
    "a,u1,13,2.5,B1\r"
    "b,u1,16,NA,B2\r"
    "c,NA,20,4,mt"
)


def test_csv_with_bare_carriage_returns(spark, tmp_path):
    path = tmp_path / "obs.csv"
    path.write_bytes(RAW.encode())
    df = read_observations(spark, str(path))
    assert df.columns == ["ID", "Clone", "Temperature", "Mean_Rep", "Stage"]
    assert dict(df.dtypes)["Temperature"] == "int"
    rows = {r.ID: r for r in df.collect()}
    assert rows["b"].Mean_Rep is None and rows["c"].Clone is None and rows["a"].Mean_Rep == 2.5
    text = read_observations(spark, str(path), all_string=True)
    assert {t for _, t in text.dtypes} == {"string"}
    repaired = text.select(F.col("Stage").try_cast("int").alias("v")).collect()
    assert [r.v for r in repaired] == [None] * 3


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        write_table(df, path, fmt)
        if fmt == "csv":
            back = read_observations(spark, path, schema="k string, v double")
        else:
            back = spark.read.parquet(path)
        assert sorted(map(tuple, back.collect())) == [("a", 1.5), ("b", None)]


def test_null_rules_of_aggregates(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("b", None), ("c", 2.0), ("c", 4.0)], "k string, y double"
    )
    y = F.col("y")
    rows = {
        r.k: r
        for r in df.groupBy("k")
        .agg(C.total(y).alias("t"), C.strict_mean(y).alias("m"), F.avg("y").alias("a"))
        .collect()
    }
    assert (rows["a"].t, rows["a"].m, rows["a"].a) == (1.0, None, 1.0)
    assert (rows["b"].t, rows["b"].m, rows["b"].a) == (0.0, None, None)
    assert (rows["c"].t, rows["c"].m) == (6.0, 3.0)


def test_standard_error_divisors(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, None)], "k int, y double")
    sd = math.sqrt(2.0)
    for rule, n in (("valid", 2), ("rows", 3), (10, 10)):
        assert summarising.mean_se(df, ["k"], "y", rule).first().se == pytest.approx(sd / math.sqrt(n))
    one = spark.createDataFrame([(1, 1.0)], "k int, y double")
    assert summarising.mean_se(one, ["k"], "y").first().se is None


def test_recode_relabel_and_keys(spark):
    df = spark.createDataFrame([("Acute",), ("Aclim",), (None,), ("x",)], "e string")
    strict = [r.v for r in df.select(C.recode(F.col("e"), {"Acute": "Acute", "Aclim": "Acclim"}).alias("v")).collect()]
    loose = [r.v for r in df.select(C.relabel(F.col("e"), {"Aclim": "Acclim"}).alias("v")).collect()]
    assert strict == ["Acute", "Acclim", None, None]
    assert loose == ["Acute", "Acclim", None, "x"]
    key = df.select(C.composite_key([F.col("e"), F.lit(1)], "-").alias("k"))
    assert [r.k for r in key.collect()] == ["Acute-1", "Aclim-1", "NA-1", "x-1"]
    parts = spark.createDataFrame([("D10_A13.x.y",)], "k string").select(
        *C.split_key(F.col("k"), ["a", "b", "c", "d"], ".")
    )
    assert tuple(parts.first()) == ("D10_A13", "x", "y", None)
    assert [r.v for r in df.select(C.level_rank(F.col("e"), ["x", "Acute"]).alias("v")).collect()] == [2, None, None, 1]


def test_label_policies(spark):
    df = spark.createDataFrame([("u1",), ("u2",), ("u3",), (None,)], "unit string")
    dropped = cleaning.clean_labels(df, drops={"unit": ["u2"]})
    assert sorted(r.unit for r in dropped.collect()) == ["u1", "u3"]
    merged = cleaning.clean_labels(df, merges={"unit": {"u2": "u3"}})
    assert [r.unit for r in merged.collect()] == ["u1", "u3", "u3", None]


def test_analysis_frame_scales_before_it_drops(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1), ("b", 2.0, None), ("c", 6.0, 3)], "unit string, y double, other int"
    )
    out = {r.unit: r.y_z for r in cleaning.analysis_frame(df, ["y"], ["unit"]).collect()}
    assert set(out) == {"a", "c"}
    assert out["a"] == pytest.approx((1 - 3) / math.sqrt(7.0))


def test_null_safe_full_join(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(None, "p"), (2, "q")], "k int, b string")
    plain = joining.natural_join(a, b, "full")
    safe = joining.natural_join(a, b, "full", null_safe=True)
    assert plain.count() == 4
    assert {tuple(r) for r in safe.collect()} == {(1, "x", None), (None, "y", "p"), (2, None, "q")}


def test_pair_summary_equals_the_multiplied_join(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0)], "k int, ya double")
    b = spark.createDataFrame([(1, 10.0), (1, None), (1, 30.0), (3, 7.0)], "k int, yb double")
    got = {r.k: tuple(r)[1:] for r in joining.paired_rows_summary(a, b, ["k"], "ya", "yb").select(
        "k", "mean_ya", "mean_yb", "n_rows").collect()}
    want = {
        r.k: tuple(r)[1:]
        for r in a.join(b, "k", "full").groupBy("k")
        .agg(F.avg("ya"), F.avg("yb"), F.count(F.lit(1))).collect()
    }
    assert got == want


def test_grid_and_too_many_levels(spark):
    df = spark.createDataFrame([("u1", "a"), ("u2", "b")], "unit string, f string")
    grid = joining.prediction_grid(df, "unit", ["f"], "x", 0, 1, 5)
    assert grid.count() == 2 * 2 * 5
    many = spark.range(20).select(F.col("id").cast("string").alias("f"))
    with pytest.raises(Exception, match="more than 5 levels"):
        many.limit(1).withColumn("v", joining.levels_array(many, "f", 5)).collect()
    assert [round(r.x, 3) for r in joining.linspace(spark, 0, 1, 3).collect()] == [0.0, 0.5, 1.0]
    assert joining.steps(spark, 0, 100, 10).count() == 11


def test_wide_form_refuses_repeated_keys(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0), (2, 0, 4.0)], "k int, x int, y double")
    wide = {r.k: (r.lo, r.hi) for r in reshaping.to_wide(df, ["k"], "x", {0: "lo", 1: "hi"}, "y").collect()}
    assert wide == {1: (2.0, 3.0), 2: (4.0, None)}
    with pytest.raises(Exception, match="more than one row"):
        reshaping.to_wide(df.union(df), ["k"], "x", {0: "lo"}, "y").collect()


def test_nest_cuts_big_groups_and_keeps_copies(spark):
    hot = spark.range(5000).select(F.lit("hot").alias("k"), (F.col("id") % 700).cast("int").alias("v"))
    df = hot.union(spark.createDataFrame([("cold", 1), ("cold", 1), (None, 3)], "k string, v int"))
    nested = reshaping.nest(df, ["k"], max_rows=100)
    sizes = nested.select("k", F.size("data").alias("s"), "n_rows").collect()
    assert max(r.s for r in sizes) < 250 and sum(r.n_rows for r in sizes) == 5003
    back = reshaping.unnest(nested, ["k"])
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


def test_profile_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "n int, s string")
    got = {r.column: (r.n, r.n_null, r.n_distinct) for r in inspecting.profile(df).collect()}
    assert got == {"n": (3, 0, 2), "s": (3, 1, 2)}
    assert inspecting.profile(df, approximate=True).count() == 2


LOG = [
    # id, stage, age, body, births
    ("a", "A", 1, 1.0, 0), ("a", "A", 3, 2.0, 4), ("a", "A", 5, 4.0, 6),
    ("b", "A", 2, 1.5, None), ("b", "A", 4, None, 3), ("b", "A", 6, 3.0, 2),
    ("c", "A", 0, 2.0, 1),
]


def test_traits(spark):
    df = spark.createDataFrame(LOG, "id string, stage string, age int, body double, births int")
    out = {r.id: (r.output, r.effort) for r in traits.lifetime_output(df, ["id"], "births", "body").collect()}
    assert out["a"] == (10, pytest.approx(10 / 3.0)) and out["b"] == (5, None) and out["c"] == (1, 0.5)
    slope = {r.id: r.growth for r in traits.growth_slope(df, ["id"], "age", "body").collect()}
    assert slope["a"] == pytest.approx(math.log(4.0) / 4) and slope["c"] is None
    ends = {r.id: r.growth for r in traits.growth_endpoint(df, ["id"], ["age"], "age", "body").collect()}
    assert ends["a"] == pytest.approx(math.log(4.0) / 5) and ends["c"] is None
    took = {r.id: r.growth for r in traits.growth_endpoint(df, ["id"], ["age"], "age", "body", True).collect()}
    assert took["a"] == pytest.approx(math.log(4.0) / 4)
    score = {r.id: r.score for r in traits.max_score(df, ["id"], {"births": 10.0, "age": 1.0}).collect()}
    assert score["a"] == 65.0


def test_net_reproduction_of_an_empty_product_is_zero(spark):
    df = spark.createDataFrame(
        [("u", "B1", 0.5, 4.0), ("u", "B2", 1.0, None), ("v", "B1", None, 3.0), ("u", "B3", 1.0, 9.0)],
        "k string, stage string, lx double, mx double",
    )
    got = {r.k: r.ro for r in traits.net_reproduction(df, ["k"], "stage", ["B1", "B2"], "lx", "mx").collect()}
    assert got == {"u": 2.0, "v": 0.0}
    cum = traits.net_reproduction(df, ["k"], "stage", ["B1", "B2", "B3"], "lx", "mx", cumulative=True)
    assert {tuple(r) for r in cum.collect()} == {("u", 2.0, 2.0, 11.0), ("v", 0.0, 0.0, 0.0)}


def test_grid_of_more_levels_than_a_bucket(spark):
    rows = [(u, f"f{i}", i) for u in (1, 2, None) for i in range(57)] + [(1, None, 0)]
    df = spark.createDataFrame(rows, "u int, f string, x int")
    pairs = joining.beside_all(df.select("u").where("u IS NOT NULL").distinct(), df.select("f", "x").where("f IS NOT NULL").distinct(), 10)
    assert sorted(map(tuple, pairs.collect())) == sorted((u, f"f{i}", i) for u in (1, 2) for i in range(57))
    none = joining.beside_all(df.select("u"), df.select("f").where("f = 'nowhere'"))
    assert none.count() == 0
    many = spark.range(12_000).select(F.lit(1).alias("u"), F.col("id").cast("string").alias("f"), F.lit(0.5).alias("x"))
    assert joining.prediction_grid(many, "u", ["f"], "x", 0, 1, 2).count() == 24_000


def test_profile_counts_each_column_once(spark):
    df = spark.createDataFrame([(1, None, 0.0), (1, "a", -0.0), (2, "b", float("nan")), (2, "b", float("nan"))], "i int, s string, d double")
    got = {r.column: (r.type, r.n, r.n_null, r.n_distinct) for r in inspecting.profile(df).collect()}
    assert got == {"i": ("int", 4, 0, 2), "s": ("string", 4, 1, 2), "d": ("double", 4, 0, 2)}
    assert {(r.n, r.n_null, r.n_distinct) for r in inspecting.profile(df.limit(0)).collect()} == {(0, 0, 0)}
    plan = inspecting.profile(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
