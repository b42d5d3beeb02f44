"""Periodic runs against brute force, hard inputs and defined cases."""

import hashlib
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from curvewise.llm import periodic_runs
from curvewise.llm.queries import LLM_QUERIES, runs_digest


def brute_force(w, least=12):
    """Every maximal stretch of matches on every diagonal, its smallest period by trying all."""
    found = set()
    for q in range(1, len(w)):
        i = q
        while i < len(w):
            first = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            start, length = first - q, i - first + q
            if i > first and length >= max(least, 2 * q):
                if not any(all(w[k] == w[k + p] for k in range(start, i - p)) for p in range(1, q)):
                    found.add((start, length, q))
            i += i == first
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def made_text(rng):
    n, letters = rng.randint(0, 90), rng.choice([1, 2, 3, 8, 60])
    w = [f"w{rng.randrange(letters)}" for _ in range(n)]
    if n and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randint(1, 25)
        b = min(n, a + p * rng.randint(2, 6))
        w[a:b] = [w[a + (i - a) % min(p, n - a)] for i in range(a, b)]
    return " ".join(w)


@pytest.mark.parametrize("least", [2, 3, 5, 8, 12, 20])
def test_runs_and_collapsed_text(least):
    rng = random.Random(least)
    for _ in range(40):
        texts = [made_text(rng) for _ in range(20)]
        for text, (n, runs, rest) in zip(texts, periodic_runs.runs_of_texts(texts, least), strict=True):
            w = text.split()
            assert n == len(w)
            assert runs == brute_force(w, least)
            assert rest.decode() == collapsed(w, runs)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(periodic_runs, "mixed", lambda x: x % 7)
    rng = random.Random(4)
    texts = [made_text(rng) for _ in range(100)]
    assert [r[1] for r in periodic_runs.runs_of_texts(texts, 12)] == [brute_force(t.split()) for t in texts]


def test_long_texts_of_few_words_take_no_square_of_time():
    n = 200_000
    fibonacci = ["a", "a b"]
    while len(fibonacci[-1]) < 2 * n:
        fibonacci.append(f"{fibonacci[-1]} {fibonacci[-2]}")
    hard = ["a " * n, "a b " * (n // 2), "b " + "a " * (n // 2) + "c " + "a " * (n // 2), ("x " * 999 + "y ") * (n // 1000), fibonacci[-1]]
    began = time.time()
    found = [periodic_runs.runs_of_texts([t], 12)[0][1] for t in hard]
    assert time.time() - began < 60  # the diagonals of one of these have 2 * 10^10 cells
    assert found[0] == [(0, n, 1)] and found[1] == [(0, n, 2)]
    assert (1, n // 2, 1) in found[2] and (n // 2 + 2, n // 2, 1) in found[2]
    assert (0, n, 1000) in found[3] and len(found[3]) == n // 1000 + 1
    assert len(found[4]) < len(hard[4].split())


def test_frames_nulls_repeats_and_clashing_columns(spark):
    text = "start " + "one two three " * 5 + "end"
    rows = [(1, text, "x"), (1, text, "x"), (None, None, "y"), (3, "", None), (4, " \t\n ", "z"), (5, "One one " * 6, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string").withColumn("doc", F.lit(1)).withColumn("collapsed", F.lit(None))
    got = periodic_runs.find_runs(docs).select("doc.doc_id", "n_words", "runs", F.col("collapsed").alias("rest")).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 6
    assert [tuple(r) for r in by_id[1].runs] == [(1, 15, 3)] and by_id[1].rest == "start one two three end"
    assert [tuple(r) for r in by_id[5].runs] == [(0, 12, 2)] and by_id[5].rest == "One one"
    for i in (None, 3, 4):
        assert by_id[i].runs == [] and by_id[i].rest == "" and by_id[i].n_words == 0
    digest = {r.doc_id: r for r in runs_digest(periodic_runs.find_runs(docs)).collect()}
    assert (digest[3].n_runs, digest[3].start, digest[3].length, digest[3].period, digest[3].exponent_milli) == (0, None, None, None, None)
    assert digest[3].runs_sha256 == digest[3].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert digest[1].exponent_milli == 5000
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def test_query_over_whole_texts(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in LLM_QUERIES["op13_periodic_runs"](spark, folder).collect()}
    some = 0
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        w = (r.text or "").encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        w = [x.decode() for x in w]
        runs = brute_force(w) if n < 3000 else [tuple(x) for x in periodic_runs.runs_of_texts([" ".join(w)], 12)[0][1]]
        mine = got.pop(r.doc_id)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        assert (mine.n_runs, mine.start, mine.length, mine.period) == (len(runs), *best)
        assert mine.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert mine.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert mine.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
        some += bool(runs)
    assert some > 5 and not got
