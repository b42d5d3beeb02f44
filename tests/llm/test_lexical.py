"""Ranked search against brute force and SQL, the plan of shared sums, and defined cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvewise.llm import lexical, sharing
from curvewise.llm.queries import LLM_ORACLES, LLM_QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, top=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        ask, found = Counter(terms(text)), []
        for i, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n_docs // total
            score = sum(
                c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
                for t, c in ask.items()
                if bag[t]
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:top], 1)]
    return out


def made(rng, n):
    odd = [" ", "\n", ", ", "-", "  ", "\x7f", "_"]
    words = ["the", "The", "éa", "中文", "x1", "Y", "z"] + [f"w{k}" for k in range(60)]
    return "".join(rng.choice(words[: rng.randint(3, len(words))]) + rng.choice(odd) for _ in range(n))


def test_terms_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = ["".join(chr(rng.choice([rng.randrange(0x80), rng.randrange(0x80, 0x3000)])) for _ in range(40)) for _ in range(500)]
    for text in [*texts, "", None]:
        assert [t.decode() for t in lexical.terms_of(text)] == terms(text)


@pytest.mark.parametrize("seed", range(6))
def test_plan_gives_every_sum_with_fewer_additions(seed):
    rng = random.Random(seed)
    groups = [[rng.randrange(80) for _ in range(rng.randint(1, 25))] for _ in range(8)]
    bags = [Counter(rng.choice(groups) + rng.choice(groups) + [rng.randrange(80) for _ in range(rng.randint(0, 6))]) for _ in range(60)]
    bags += [Counter(), bags[0], bags[1]]
    plan = sharing.mine(bags)
    values = np.random.default_rng(seed).integers(0, 1000, (80, 7))
    want = np.array([sum((values[t] * c for t, c in b.items()), np.zeros(7, np.int64)) for b in bags])
    assert (plan.evaluate(values) == want).all()
    assert plan.additions < 0.6 * sum(max(len(b) - 1, 0) for b in bags)


def test_plan_of_wide_sets_and_of_none():
    assert sharing.mine([]).evaluate(np.zeros((0, 3), np.int64)).shape == (0, 3)
    bags = [Counter(range(k, 3000 + k)) for k in range(5)]
    plan = sharing.mine(bags)
    values = np.arange(3010)[:, None]
    assert plan.evaluate(values).ravel().tolist() == [sum(range(k, 3000 + k)) for k in range(5)]


@pytest.fixture(scope="module")
def given(spark):
    rng = random.Random(8)
    docs = [(k, made(rng, rng.randint(0, 60))) for k in range(150)]
    docs += [(k + 200, docs[k % 3][1]) for k in range(60)] + [(5, docs[9][1]), (None, docs[7][1]), (None, docs[7][1]), (900, None), (901, ""), (902, "-- ,")]
    items = [(k, made(rng, rng.randint(1, 30))) for k in range(25)] + [(50, "the the the The"), (51, None), (52, ""), (53, "nowhere"), (54, docs[0][1])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1)).withColumn("n", F.lit("x"))
    asked = spark.createDataFrame(items, "item_id int, text string").withColumn("score", F.lit(1)).withColumn("doc_id", F.lit("x"))
    return docs, items, frame.repartition(3), asked


@pytest.mark.parametrize(("top", "block"), [(20, 50_000), (3, 60), (1, 1)])
def test_ranks(given, monkeypatch, top, block):
    docs, items, frame, asked = given
    monkeypatch.setattr(lexical, "CELLS", 5000)
    got = lexical.rank(frame, asked, top=top, block_terms=block)
    assert got.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_force(docs, items, top)))


def test_repeated_items_and_empty_tables(given):
    docs, items, frame, asked = given
    twice = lexical.rank(frame, asked.where("item_id < 2").union(asked.where("item_id < 2")), top=5).collect()
    by_item = defaultdict(Counter)
    for r in twice:
        by_item[r.item_id][r.rank] += 1
    assert all(set(c.values()) == {2} for c in by_item.values()) and len(by_item) == 2
    assert lexical.rank(frame.limit(0), asked).count() == 0
    assert lexical.rank(frame, asked.limit(0)).count() == 0


def test_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.register(name, spark.read.parquet(f"{folder}/{name}.parquet").toArrow())
    want = con.execute(LLM_ORACLES["op12_lexical"]).fetchall()
    got = [tuple(r) for r in LLM_QUERIES["op12_lexical"](spark, folder).collect()]
    assert len(want) > 100 and sorted(want) == sorted(got)
