"""Byte-level pair encoding against the public library, exact round trips and defined cases."""

import base64
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvewise.llm import byte_bpe, pretokens
from curvewise.llm.queries import LLM_QUERIES
from curvewise.llm.tokens import default_paths

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
PARTS = [*"aabstmdrevlN  \n\t12.,!-'é中　 \x85\x1c\x00\U0001f600́", "'re", "'ll", "'s", "<|endoftext|>", " the", "word"]


@pytest.fixture(scope="module")
def library():
    with open(default_paths()[1], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    return [*made, "x" * 70_000, "ab" * 40_000, "", " ", "'", "''s", "I'll've '", "\n's", "  's", " \n ", "中" * 3000]


def numbers(data):
    return np.frombuffer(data, "<u4").tolist()


def test_ids_and_offsets_as_the_library(library, texts):
    model = byte_bpe.Merger(default_paths()[1])
    ids, starts = model.encode(texts)
    for text, a, b in zip(texts, ids, starts, strict=True):
        assert numbers(a) == library.encode_ordinary(text)
        sizes = [len(library.decode_single_token_bytes(i)) for i in numbers(a)]
        assert numbers(b) == [sum(sizes[:k]) for k in range(min(len(sizes), 50))] + numbers(b)[50:]
    assert model.decode(ids, starts) == [t.encode() for t in texts]


def test_both_ways_of_merging_agree_and_a_full_cache_is_emptied(monkeypatch):
    rng = random.Random(2)
    model = byte_bpe.Merger(default_paths()[1])
    pieces = sorted({bytes(rng.choice(b"etaoinshr \xc3\xa9") for _ in range(rng.randint(1, 40))) for _ in range(2000)})
    assert [numbers(x) for x in model.merge_many(pieces)] == [model.merge(p) for p in pieces]
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 100)
    for k in range(0, len(pieces), 60):
        assert [numbers(x) for x in model.pieces(pieces[k : k + 60] * 2)] == [model.merge(p) for p in pieces[k : k + 60]] * 2
        assert len(model.cache) <= 100


def test_scan_over_stretches_is_the_step_by_step_automaton():
    rng = np.random.default_rng(1)
    for n in (1, 2, 511, 512, 513, 40_000):
        symbols = rng.integers(0, pretokens.NONE, n).astype(np.uint8)
        symbols[rng.random(n) < 0.5] = pretokens.LETTER
        # what may follow a glued space and a contraction is settled before the scan
        for k in range(1, n):
            if symbols[k - 1] == pretokens.GLUE and symbols[k] in (pretokens.GLUE, pretokens.LAST, pretokens.BLANK, pretokens.EDGE):
                symbols[k] = pretokens.OTHER
        state, want = pretokens.CLOSED, []
        for symbol in symbols.tolist():
            state, begins = pretokens._step(state, symbol)
            want.append(begins)
        assert pretokens.automaton().starts(symbols).tolist() == want


def test_classes_of_all_code_points_agree_with_the_library():
    """A sign merges with a letter, number, sign or blank before it only where both have one class."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or unicodedata.category(chr(c)) != "Lo")][::3]
    table = pretokens.classes()
    for lead, kind in ((b"a", pretokens.LETTER), (b"1", pretokens.NUMBER), (b"!", pretokens.OTHER)):
        ranks = {bytes([i]): i for i in range(256)} | {lead + bytes([i]): 256 + i for i in range(256)}
        probe = tiktoken.Encoding("probe", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        wrong = [c for c in points if (probe.encode_ordinary(lead.decode() + chr(c))[0] >= 256) != (table[c] == kind)]
        assert not wrong


def test_long_texts_in_parts(library, texts, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE", 200)
    monkeypatch.setattr(byte_bpe, "LAID", 70)
    model = byte_bpe.Merger(default_paths()[1])
    rng = random.Random(9)
    for _ in range(40):
        text = " ".join(rng.sample(texts[:3000], 40)) + " "
        assert "".join(byte_bpe.parts(text, 200)) == text
        ids, starts = model.encode([text])
        assert numbers(ids[0]) == library.encode_ordinary(text)
        assert model.decode(ids, starts) == [text.encode()]


def test_frames_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, "It's 12 o'clock", "x"), (1, "It's 12 o'clock", "x"), (None, None, "y"), (3, "", None), (4, " a" * 4000, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").withColumn("doc", F.lit(1)).withColumn("starts", F.lit(None))
    coded = byte_bpe.encode(docs)
    got = byte_bpe.decode(coded).select("doc.doc_id", "doc.ids", "n_tokens", F.col("ids").alias("got"), "decoded").collect()
    want = [(i, x, t or "") for i, t, x in rows]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r[1], bytes(r.decoded).decode())) for r in got)
    assert all(numbers(r.got) == library.encode_ordinary(bytes(r.decoded).decode()) and r.n_tokens == len(numbers(r.got)) for r in got)
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0))).count() == 0


def test_query_over_whole_texts(spark, library):
    import hashlib

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in LLM_QUERIES["op11_byte_bpe"](spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        mine = got.pop(r.doc_id)
        assert mine.n_tokens == len(ids)
        assert mine.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert mine.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert not got
