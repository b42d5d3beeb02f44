"""The text operators against brute force, exact round trips and defined cases."""

import collections
import hashlib
import itertools
import json
import math
import pickle
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from curvewise.llm import (
    exact_dedup, gru, language, language_model, mixing, near_dedup, neighbours, packing, pii, token_counts, url_filter,
)
from curvewise.llm.components import connected
from curvewise.llm.hilbert import hilbert_keys
from curvewise.llm.queries import URL_RULES
from curvewise.llm.tokens import default_paths, encoder

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, row bigint, node string, rank int"
ODD = ["", None, "   ", "a", "A", "a  b", "a\tb", "a b", " a b", "<|endoftext|> x", "x" * 5000, "é ü ß 　 z", "1.2.3.4", "\n\n a \n", "one"]


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 60)) for _ in range(n))


def rows_of(texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en" if k % 2 else "de", f"s{k % 3}" if k % 7 else None, None, "clash", 1, "n", k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    texts = list(ODD)
    for _ in range(25):
        base = words(rng, rng.randint(5, 80)).split()
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            texts.append(" ".join(copy))
    texts += [texts[20], texts[21].upper(), texts[22].replace(" ", "  "), words(rng, 6000)]
    return texts


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(rows_of(corpus) + rows_of([corpus[30], corpus[31], "null id"], [None, 5, None]), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def order(i):
    return (i is None, i or 0)


def test_exact_groups_and_kept_rows(docs, none):
    given = docs.select("doc_id", "text").collect()
    groups = collections.defaultdict(list)
    for r in given:
        groups[normal(r.text)].append(r.doc_id)
    got = exact_dedup.duplicate_groups(docs).collect()
    want = []
    for text, ids in groups.items():
        best = min(ids, key=order)
        want += [(i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(normal(r.text) for r in kept.collect()) == sorted(groups)
    light = exact_dedup.duplicate_groups(docs, support=0.1).collect()
    assert sorted(map(repr, light)) == sorted(map(repr, got))
    assert exact_dedup.duplicate_groups(none).count() == 0 and exact_dedup.keep_first(none).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def brute_components(given, size):
    sets = []
    for r in given:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) if x]
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(given):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id, key=order)
    return [(r.doc_id, len(sets[i]), least[find(i)] if sets[i] else r.doc_id) for i, r in enumerate(given)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_groups(docs, none, size, monkeypatch):
    monkeypatch.setattr(near_dedup, "HUBS", 1)  # so that late links are needed
    got = near_dedup.near_groups(docs, size=size).collect()
    want = brute_components(docs.select("doc_id", "text").collect(), size)
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    if size == 5:
        kept = near_dedup.keep_one(docs)
        assert kept.columns == docs.columns
        assert kept.count() == sum(r.stays for r in got)
        assert near_dedup.near_groups(none).count() == 0


def test_no_pair_is_lost_in_large_buckets():
    """Thousands of pairs at 0.8, each in the first band that it shares by the whole key."""
    rng, hashes, found, lost = np.random.default_rng(9), near_dedup.WordHashes(), 0, []
    sides = []
    for _ in range(6000):
        words = [f"w{x}" for x in rng.choice(10**6, 100, False)]
        sides += [" ".join(words[:90]), " ".join(words[10:])]
    sets = [near_dedup.shingle_hashes(x, hashes, 1) for x in sides]
    sketch = near_dedup.sketches(sets)
    keys, small = near_dedup.band_keys(sketch), near_dedup.mixed(sketch).astype(np.uint8)
    meet = keys[::2] == keys[1::2]
    for band in range(near_dedup.BANDS):
        pairs = np.flatnonzero(meet.any(axis=1) & (meet.argmax(axis=1) == band))
        for some in np.array_split(pairs, max(1, len(pairs) // 100)):
            rows = [
                {"node": b"%d" % i, "root": b"%d" % i, "n": len(sets[i]), "sketch": small[i].tobytes(), "before": keys[i, :band].tolist(), "text": sides[i]}
                for p in some for i in (2 * p, 2 * p + 1)
            ]
            links = near_dedup._block_links(True, rows, rows, hashes, 1, 80)
            found += len(links)
            lost += set(some.tolist()) - {int(a) // 2 for a, _ in links}
    assert near_dedup.linked(sets[0], sets[1], 80) and found + len(lost) > 5990
    assert lost == []


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [pool[:1], pool[:3], pool[:1000], pool[100:1100]]
    s = near_dedup.sketches(sets, 512)
    assert (s != np.uint64(2**64 - 1)).all()
    assert abs((s[2] == s[3]).mean() - 900 / 1100) < 0.1


def test_hilbert_steps_are_neighbours():
    grid = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    keys = hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=16).tolist() for i in range(400)}
    for i in range(50, 70):
        vectors[i] = vectors[50]
    bad = [(900, None), (901, [0.0] * 16), (902, [None] + [1.0] * 15), (903, [float("nan")] * 16), (950, [1.0, 2.0]), (951, [])]
    df = spark.createDataFrame([*vectors.items(), *bad], "vec_id bigint, embedding array<float>").withColumn("row", F.lit(1))
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    x = np.array([np.array(v, np.float32) for v in vectors.values()], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 400, 50):
        s = np.round(unit @ unit[q], 9)
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:5]
        assert got[q] == [(i, s[i]) for i in best]
    assert set(got) == set(range(0, 400, 50))
    assert neighbours.nearest(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_token_counts_follow_edits(spark, docs, none):
    enc = encoder(*default_paths())
    rng = random.Random(4)
    pool = [t or "" for t in ODD] + [words(rng, 30), "it's  we're 12 34\n\n x", "a<|endoftext|>b c"]
    for _ in range(300):
        text = rng.choice(pool)
        tree = token_counts.CountTree(text, enc)
        for _ in range(3):
            a, b = sorted(rng.randint(0, len(text) + 2) for _ in range(2))
            put = rng.choice(["", " ", "x", "'re y", "  ", "\n", "<|endoftext|>", " two words"])
            tree.edit(a, b, put)
            a, b = min(a, len(text)), min(b, len(text))
            text = text[:a] + put + text[b:]
            assert tree.tokens == len(enc.full.encode(text, add_special_tokens=False).ids), text
    edits = F.array(token_counts.edit(F.lit(0), F.lit(1), F.lit("Q ")), token_counts.edit(F.lit(None), F.lit(1), F.lit("")))
    for r in token_counts.edited_counts(docs.where("doc_id is not null"), edits).collect():
        assert r.n_edits == 1
    assert token_counts.edited_counts(none, edits).count() == 0


def test_url_filter(spark):
    urls = [
        None, "no scheme", "http://", "http://A.NET", "http://a.net/x", "https://B.Example.NET/en/p?q#f", "http://example.net/enx",
        "http://example.com/de/1", "http://notexample.com/de/1", "http://x.org/fr/", "http://x.org?/fr/", "ftp://u@x.org:8/fr/#",
    ] + [f"http://site{i}.net/buy/{i}" for i in range(60)] + [f"http://site{i}.org/fr/{i}" for i in range(60)] + ["http://site7.com/buy/7", "http://site8.de/fr/8"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("rule", F.lit("clash"))

    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]

    for r in url_filter.judge(df, URL_RULES).collect():
        host, path = parts(urls[r.page_id])
        assert (r.host, r.path) == (host, path)
        fit = [x for x in URL_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.text), default=None)
        assert r.rule == (best.text if best else None)
        if best:
            assert r.verdict == best.verdict
        elif r.page_id < 2:
            assert r.verdict == "allow"
        elif "buy" in path:
            assert r.verdict == "block"
        elif path.startswith("/fr/8"):
            assert r.verdict == "allow"
    assert {r.verdict for r in url_filter.judge(df.where("page_id < 2"), URL_RULES).collect()} == {"allow"}
    assert url_filter.judge(df.where("false"), URL_RULES).count() == 0


def test_packing_round_trip(docs, none):
    enc = encoder(*default_paths())
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(docs).collect():
        pieces[r.doc_id, r.row].append(r)
        places[r.sequence_id].append(r)
    wanted = collections.Counter()
    for r in docs.collect():
        wanted[r.doc_id, np.array(enc.full.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()] += 1
    found = collections.Counter()
    for (i, _), rows in pieces.items():
        rows.sort(key=lambda r: r.start)
        assert all(a.start + a.length == b.start for a, b in zip(rows, rows[1:], strict=False))
        found[i, b"".join(bytes(r.ids) for r in rows)] += 1
        assert {r.doc_tokens for r in rows} == {sum(r.length for r in rows)}
    assert found == wanted
    for rows in places.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        total = sum(r.length for r in rows)
        assert total <= 2048 and total & (total - 1) == 0
    assert packing.pack(none).count() == 0


def test_mixing(docs, none):
    rng = random.Random(2)
    for _ in range(30):
        shares = [rng.randint(1, 40) for _ in range(rng.randint(1, 12))]
        had = [0] * len(shares)
        for t, s in enumerate(mixing.period(shares), 1):
            had[s] += 1
            assert all(abs(h * sum(shares) - t * a) < sum(shares) for h, a in zip(had, shares, strict=True))
    rows = mixing.mix(docs, block=2, ticks=100, weights={None: 1, "s0": 5, "s1": 2, "s2": 2}).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(rows)))
    first = collections.Counter(json.dumps(r.doc.asDict(), sort_keys=True) for r in rows if r.epoch == 0)
    assert first == collections.Counter(json.dumps(r.asDict(), sort_keys=True) for r in docs.collect())
    half = len(rows) // 4 * 2
    assert abs(sum(r.source == "s0" for r in rows[:half]) - half / 2) <= 4
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() >= docs.count()
    assert mixing.mix(none).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, weights={"s0": 1})


def test_mixing_keeps_true_weights():
    for many in (20, 1000, 6000):
        wanted = [1 / 3] + [2 / 3 / (many - 1)] * (many - 1)
        exact, had = mixing.whole_weights(wanted), 0
        for t, (s, _) in enumerate(itertools.islice(mixing.slots(exact), 16_026), 1):
            had += s == 0
            assert abs(had - t * wanted[0]) < 1 + 1e-9  # the weights' floats add up to one but for rounding
    rng = random.Random(4)
    exact = mixing.whole_weights([rng.random() ** 4 + 1e-6 for _ in range(60)])
    total, had = sum(exact), [0] * 60
    for t, (s, i) in enumerate(itertools.islice(mixing.slots(exact), 4000), 1):
        assert i == had[s]
        had[s] += 1
        assert all(abs(h * total - t * a) < total for h, a in zip(had, exact, strict=True))


def test_mixing_of_many_sources(spark):
    many = 5_500
    docs = spark.range(3 * many).select(F.col("id").alias("doc_id"), F.when(F.col("id") < many, F.col("id")).otherwise(0).cast("string").alias("source"))
    rows = mixing.mix(docs, block=2, ticks=4_000).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(rows)))
    assert {r.doc.doc_id for r in rows if r.epoch == 0} == set(range(3 * many))
    share, had = (2 * many + 1) ** mixing.ALPHA, 0
    share /= share + many - 1
    for t, r in enumerate(rows[::2], 1):
        had += r.source == "0"
        assert abs(had - t * share) < 1 + 1e-9


def base_by_definition(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii(docs, none):
    rng = random.Random(8)
    for letters in ("a1.@-+ (_2.@9", "0123456789 -", "4 0-"):
        for _ in range(4000):
            t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
            assert pii.base_spans(t) == base_by_definition(t)
    for text, found in {
        "mail jo dot doe at host dot com now": "jo dot doe at host dot com",
        "x [at] y (dot) org": "x [at] y (dot) org",
        "jоhn@exаmple.com!": "jоhn@exаmple.com",
        "tel plus one five five five one two three four": "plus one five five five one two three four",
        "at 192 dot 168 dot one dot 5.": "192 dot 168 dot one dot 5",
        "it is +1 (5５5) 555-0199": "+1 (5５5) 555-0199",
        "a­b​@c.de": "a­b​@c.de",
    }.items():
        assert found in [text[a:b] for _, a, b, base in pii.spans_of(text) if not base]
    for clean in ("look at example.com or ask at one dot two", "one two three go at it", "Ein Zeichen: – und ‘so’ é", None, ""):
        assert pii.spans_of(clean) == []
    got = pii.find_spans(docs).collect()
    assert len(got) == docs.count() and pii.find_spans(none).count() == 0


def test_language(spark, docs, none):
    rng = random.Random(6)
    pools = {"aa": [f"ka{c}lo" for c in "bdfgh"], "bb": [f"su{c}ri" for c in "bdfgh"]}
    rows = [(i, " ".join(rng.choice(pools[k]) for _ in range(20)), k) for i in range(200) for k in ("aa", "bb")]
    df = spark.createDataFrame([*rows, (1, None, "aa"), (2, "12 !", "bb"), (None, "kaxlo kaylo", None), (3, "", None)], "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    model = language.fit(df)
    for r in language.identify(df, model).collect():
        letters = any(c.isalpha() for c in r.doc.text or "")
        assert r.lang_pred == ((r.doc.lang or "aa") if letters else "und")
        assert 0 <= r.score <= 1
    empty = language.fit(none)
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}
    assert language.identify(none, model).count() == 0


def test_pipeline_rejects_what_is_no_learnt_language(spark):
    rng = random.Random(12)
    pools = {
        "de": "der die das und ist nicht ein eine haus hund katze schule kinder heute morgen schön straße wasser zeit zwischen".split(),
        "en": "the and is not a house dog cat school children today tomorrow beautiful street water time between with this that".split(),
        "es": "el la los y es no una casa perro gato escuela niños hoy mañana hermosa calle agua tiempo entre con".split(),
        "fr": "le les des et est pas une maison chien chat école enfants hier demain belle rue eau temps entre avec".split(),
    }
    rows = [(i, " ".join(rng.choice(pools[k]) for _ in range(rng.randint(4, 40))), k) for i, k in enumerate(sorted(pools) * 100)]
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n)) for n in (30, 60, 300)]
    other = ["wczoraj poszedłem do sklepu żeby kupić chleb i mleko ale sklep był zamknięty", "сегодня хорошая погода и мы пойдём гулять в парк"]
    clean = ["der hund ist nicht das haus", "the dog is not a house", "los niños y el perro hoy", "les enfants et le chien"]
    rows += [(1000 + i, x, None) for i, x in enumerate(junk + other)] + [(2000 + i, x, None) for i, x in enumerate(clean)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.identified(spark, docs, "").collect()}
    assert kept == set(range(400)) | set(range(2000, 2004))


def test_recurrent_model_gradients_and_sum():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) + (0 if k == "word_b" else rng.normal(0, 0.3, v.shape)) for k, v in gru.new_params(np.log(np.full(11, 1 / 11)), 5, 4).items()}
    seen, target, h = rng.integers(0, 11, (6, 3)), rng.integers(0, 11, (6, 3)), rng.normal(size=(3, 5))
    grads = gru.window_gradients(p, h, seen, target, seen == 2)[2]
    for k in p:
        at = (seen[1, 1], 2) if k == "embed" else tuple(s // 2 for s in p[k].shape)
        loss = []
        for e in (1e-4, -1e-4):
            moved = {a: b.copy() for a, b in p.items()}
            moved[k][at] += e
            loss.append(gru.window_gradients(moved, h, seen, target, seen == 2)[1])
        assert abs((loss[0] - loss[1]) / 2e-4 - grads[k][at]) < 1e-2
    every = [np.array([a, b]) for a in range(11) for b in range(11)]
    assert abs(np.exp(gru.log_likelihoods(p, every, 2)).sum() - 1) < 1e-4


def test_keep_first_with_columns_that_have_no_order(spark):
    rows = [(3, "a  b", {"k": 1}), (1, "a b", {"k": 2}), (1, "a b", {"k": 2}), (None, "a b", None), (2, None, {}), (None, "c", {"z": 0})]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `m.x` map<string,int>")
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((order(r.doc_id), r.text, str(r["m.x"])) for r in kept.collect()) == sorted(
        (order(i), t, str(m)) for i, t, m in ((1, "a b", {"k": 2}), (2, None, {}), (None, "c", {"z": 0}))
    )


def test_language_sample_of_a_hot_id_and_without_text_shuffle(spark):
    name = lambda kind, i: kind + "".join("abcdefghij"[int(d)] for d in str(i))
    rows = [(None, f"the dog {name('x', i)}", "en") for i in range(3000)] + [(i, f"der hund {name('y', i)}", "de") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    part = language.fit(docs, sample=500)
    for kind in "xy":
        assert 380 < sum(w.startswith(kind) for w in part.words) < 620
    assert language.fit(docs.where("lang is null")).languages == []
    assert {r.lang_pred for r in language.identify(docs.limit(5), language.fit(docs.limit(0))).collect()} == {language.UNKNOWN}


def test_language_model_in_flat_arrays_has_the_plain_counts_scores(spark):
    """As Python objects the counts took the driver beyond its memory on tables in many partitions."""
    name = lambda kind, i: kind + "".join("abcdefghij"[int(d)] for d in str(i))
    rows = [(i, f"the é {name('xy'[i % 2], i)} {name('z', i % 50)}", ("en", "de")[i % 2]) for i in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    tracemalloc.start()
    model = language.fit(docs, sample=30_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6 and len(pickle.dumps(model)) < 5e6
    counts = {k: collections.Counter(w for _, t, lang in rows if lang == k for w in t.split()) for k in ("de", "en")}
    every = sum(counts.values(), collections.Counter())
    assert model.languages == ["de", "en"] and list(model.words) == sorted(every, key=lambda w: (-every[w], w))
    for w in ["the", "é", "za", "zej", rows[7][1].split()[2]]:
        logs = [math.log((counts[k][w] + 0.5) / (counts[k].total() + 0.5 * (len(every) + 1))) for k in counts]
        plain = np.array(logs) - np.log(np.exp(logs).sum())
        assert np.allclose(model.word_scores[model.words[w]], plain, atol=1e-6)


def test_recurrent_model_equals_one_step_at_a_time():
    rng = np.random.default_rng(4)
    p = gru.new_params(np.log(rng.dirichlet(np.ones(70))), 6, 9)
    p = {k: v + rng.normal(0, 0.4, v.shape).astype(np.float32) * (v > -1e8) for k, v in p.items()}
    texts = [rng.integers(0, 70, n) for n in (1, 2, 40, 333, 5, 5)]
    sigma = lambda v: 1 / (1 + np.exp(-v))
    want = []
    for text in texts:
        h, seen, total = np.zeros(6), 3, 0.0
        for token in text:
            g, hu = p["embed"][seen] @ p["w"] + p["b"], h @ p["u"]
            r, z = sigma(g[:6] + hu[:6]), sigma(g[6:12] + hu[6:12])
            new = np.tanh(g[12:] + r * hu[12:])
            h = new + z * (h - new)
            c, i = divmod(int(token), 9)
            for x, at in ((h @ p["class_w"] + p["class_b"], c), (h @ p["word_w"][c] + p["word_b"][c], i)):
                total += x[at] - x.max() - np.log(np.exp(x - x.max()).sum())
            h, seen = h.astype(np.float32), token
        want.append(total)
    assert np.allclose(gru.log_likelihoods(p, texts, 3), want, rtol=1e-4, atol=1e-3)
    far = {k: v * 200 if k in ("class_w", "word_w") else v for k, v in p.items()}
    assert np.isfinite(gru.log_likelihoods(far, texts, 3)).all()


def test_every_token_is_a_target_once(monkeypatch):
    met, real = collections.Counter(), gru.output_log_p

    def watched(p, h, target, grads=None):
        met.update(target.tolist())
        return real(p, h, target, grads)

    monkeypatch.setattr(gru, "output_log_p", watched)
    for size in (2, 3, 129, 1000, 8192, 8300):
        met.clear()
        stream = np.random.default_rng(size).integers(0, 50, size)
        gru.train(gru.new_params(np.log(np.full(50, 0.02)), 4, 8), stream, 0)
        assert met == collections.Counter(stream[1:].tolist())


def test_language_model_scores(docs, none):
    marked = docs.withColumn("held_out", language.held_out("doc_id", 7, 2))
    counts = collections.Counter()
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    given = docs.select("doc_id", "text").collect()
    for r in given:
        if not out(r.doc_id):
            counts.update(tokens(r.text))
    total, types = sum(counts.values()), len(counts)
    want = sorted((order(r.doc_id), len(tokens(r.text)), sum(counts[t] > 0 for t in tokens(r.text)), round(sum(math.log10((counts[t] + 1) / (total + types + 1)) for t in tokens(r.text)), 6)) for r in given)
    got = language_model.score(marked, one_in=2).collect()
    assert want == sorted((order(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got)
    assert all(r.train_tokens == total and r.score < 0 and r.held_out == out(r.doc_id) for r in got)
    empty = language_model.score(none.withColumn("held_out", F.lit(False)))
    assert empty.count() == 0


def test_every_training_document_is_learnt_from(spark, monkeypatch):
    seen, real = spark.sparkContext.accumulator(0), language_model._train_batches

    def counted(params, end):
        run = real(params, end)

        def rows(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return lambda batches: run(rows(batches))

    monkeypatch.setattr(language_model, "_train_batches", counted)
    texts = [(None if i < 40 else 7 if i < 80 else i, f"text number {i}", i % 5 == 0) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, held_out boolean")
    assert language_model.score(docs).count() == 200
    assert seen.value == 160


def test_pipeline(spark, tmp_path_factory):
    rng = random.Random(9)
    base = [words(rng, 60) for _ in range(40)]
    near = " ".join([*base[0].split()[:-1], "other"])
    rows = rows_of([*base, base[1], base[2].replace(" ", "\n"), near, "123 456", None])
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = docs
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns
        sizes.append(kept.select("doc_id").distinct().count())
    assert sizes == [43, 41, 40, 40]
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, "")
    assert {r.doc_id for r in packed.collect()} == set(range(40))
