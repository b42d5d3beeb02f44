"""Bulk splitting, counting and numbering of tokens against word by word, and the gradient vector."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from curvewise.llm import gru, language_model, words


def test_words_in_bulk_equal_words_of():
    rng = random.Random(3)
    texts = [None, "", " ", "a", " A\n", "\x1c\x85 Ä b"]
    texts += ["".join(rng.choice(" \t\n\v\f\r\x1c\x1f\x85\xa0AbÄßZ") for _ in range(rng.randrange(30))) for _ in range(300)]
    for column in (pa.array(texts), pa.array(texts).slice(3, 200), pa.array(texts, pa.large_string())):
        tokens, sizes = words.words_in(column)
        want = [words.words_of(t) for t in column.to_pylist()]
        assert (sizes.tolist(), tokens.to_pylist()) == ([len(w) for w in want], [t for w in want for t in w])


@pytest.mark.parametrize("frequent", [0, 4, 40])
def test_bulk_numbers_equal_word_by_word(frequent):
    texts = ["a b a c", None, "", "b b d", "e a  f\n", "g " * 30]
    met = collections.Counter(t for x in texts for t in [*words.words_of(x), b"\n"])
    batch = pa.record_batch({"text": pa.array(texts)})
    counted = collections.Counter()
    for b in language_model._count_batches(iter([batch.slice(0, 2), batch.slice(2)])):
        counted.update(dict(zip(b.column("token").to_pylist(), b.column("c").to_pylist(), strict=True)))
    assert counted == met
    known = sorted(met.items(), key=lambda x: (-x[1], x[0]))[:frequent]
    vocabulary = language_model.Vocabulary(known, sum(met.values()) if known else 0, len(met) if known else 0, 4)
    size = len(texts)
    rows = pa.record_batch({"id": list(range(size)), "part": [0] * size, "held_out": [False] * size, "text": texts})
    (out,) = language_model._number_batches(vocabulary)(iter([rows]))
    for text, row in zip(texts, out.to_pylist(), strict=True):
        tokens = [*words.words_of(text), b"\n"]
        at_hand = [t for t in tokens if t in vocabulary.counts]
        assert (row["n_tokens"], row["n_known"]) == (len(tokens), len(at_hand))
        assert row["base"] == pytest.approx(sum(vocabulary.log10_p(vocabulary.counts[t]) for t in at_hand))
        outside = [t for t in tokens if t not in vocabulary.number]
        unlisted = sum(vocabulary.log10_p(vocabulary.counts[t]) for t in outside if t in vocabulary.counts)
        assert row["other"] == pytest.approx(unlisted - len(outside) * vocabulary.other, abs=1e-12)
        assert {x["token"]: x["tf"] for x in row["rare"]} == collections.Counter(t for t in tokens if t not in vocabulary.counts)
        assert np.frombuffer(row["numbers"], "<u2").tolist() == [vocabulary.number.get(t, 0) for t in tokens]


def test_gradients_overwrite_a_given_vector():
    rng = np.random.default_rng(2)
    p = gru.new_params(np.log(rng.dirichlet(np.ones(30))), 6, 5)
    seen, target = rng.integers(0, 30, (2, 8, 4)).astype(np.uint16)
    h = np.zeros((4, 6), np.float32)
    _, loss, want = gru.window_gradients(p, h, seen, target, seen == 0)
    given = np.full(sum(v.size for v in p.values()), 7, np.float32)
    _, again, got = gru.window_gradients(p, h, seen, target, seen == 0, None, given)
    assert loss == again and all(np.shares_memory(got[k], given) and (got[k] == want[k]).all() for k in p)


@pytest.mark.parametrize("counted", [False, True])
def test_runs_of_states_leave_gradients_and_scores_as_they_are(monkeypatch, counted):
    """Arrays over a whole window at once left the cache and took the query over its CPU seconds."""
    rng = np.random.default_rng(5)
    p = gru.new_params(np.log(rng.dirichlet(np.ones(70))), 6, 9)
    p = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) * (v > -1e8) for k, v in p.items()}
    seen, target = np.minimum(rng.zipf(1.3, (2, 13, 5)) - 1, 69).astype(np.uint16)  # classes of most and of no states
    h, real = rng.normal(0, 0.5, (5, 6)).astype(np.float32), rng.random((13, 5)) < 0.8 if counted else None
    texts = [rng.integers(0, 70, n).astype(np.uint16) for n in (1, 40, 3, 17, 17, 2, 9)]
    most, exponentials = [0], gru._exponentials

    def watched(x, at):
        most[0] = max(most[0], len(x))
        return exponentials(x, at)

    monkeypatch.setattr(gru, "_exponentials", watched)
    found = {}
    for rows in (4, 7, 10, 10**6):
        monkeypatch.setattr(gru, "ROWS", rows)
        most[0] = 0
        found[rows] = (*gru.window_gradients(p, h, seen, target, seen == 3, real), gru.log_likelihoods(p, texts, 3))
        assert most[0] <= rows
    state, loss, grads, scores = found.pop(10**6)
    for some_state, some_loss, some_grads, some_scores in found.values():
        assert np.allclose(some_state, state, atol=1e-6) and some_loss == pytest.approx(loss, rel=1e-6)
        assert np.allclose(some_scores, scores, rtol=1e-6)
        assert all(np.allclose(some_grads[k], grads[k], atol=1e-4) for k in p)


def test_gradients_equal_differences_of_the_loss():
    rng = np.random.default_rng(8)
    p = gru.new_params(np.log(rng.dirichlet(np.ones(40))), 4, 7)
    p = {k: v.astype(np.float64) + rng.normal(0, 0.3, v.shape) * (v > -1e8) for k, v in p.items()}
    seen, target = np.minimum(rng.zipf(1.4, (2, 6, 3)) - 1, 39).astype(np.uint16)
    h, fresh = rng.normal(0, 0.5, (3, 4)), rng.random((6, 3)) < 0.2
    grads = gru.window_gradients(p, h, seen, target, fresh)[2]
    for k, v in p.items():
        flat = v.reshape(-1)
        for i in rng.permutation(np.flatnonzero(flat > -1e8))[:25]:
            kept, ends = flat[i], []
            for move in (1e-4, -1e-4):
                flat[i] = kept + move
                ends.append(gru.window_gradients(p, h, seen, target, fresh)[1])
            flat[i] = kept
            assert grads[k].reshape(-1)[i] == pytest.approx((ends[0] - ends[1]) / 2e-4, abs=1e-5), k


def test_scored_pieces_are_joined_up_to_the_limit():
    """Each small piece took as many steps as its longest text has tokens."""
    sizes = [3, 1, 2, 9, 0, 1, 4, 4]
    batches = [pa.record_batch({"row": [i], "numbers": pa.array([b"x" * n], pa.binary())}) for i, n in enumerate(sizes)]
    joined = [b.column("row").to_pylist() for b in language_model._joined(iter(batches), "numbers", 6)]
    assert joined == [[0, 1, 2], [3], [4, 5, 6], [7]]
    assert list(language_model._joined(iter([]), "numbers", 6)) == []
