"""Language identification: known words first, then shorter and shorter character n-grams.

The model is fitted on a bounded sample of labelled rows: about `SAMPLE` documents of each
language, chosen by a hash of id, text and place, whole texts. It holds the `WORDS` most frequent words
of each language and the `GRAMS` most frequent n-grams of each length and language, so its
size is bounded and it is broadcast. A word in the list scores its log frequency in each
language. Any other word is read letter by letter: each position takes the longest known
n-gram that ends there. Scores are log posteriors under equal priors; those of a text's words
are added. `score` is the mean posterior of the chosen language over the words.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is every text
if no labelled row was given. Ties go to the language that sorts first. Rows without an id
are training rows. Repeated rows count as often as they occur. An empty table gives no rows.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvewise.llm.words import mixed, text_slices

#: Labelled documents per language that the model is fitted on, about.
SAMPLE = 4000
#: Words of each language, and n-grams of each length 1 to ORDER and language, that it keeps.
WORDS, GRAMS, ORDER = 40_000, 20_000, 4
UNKNOWN = "und"
#: Where a least score lies: the quantile of the scores of held-out rows, and the share of the
#: way from chance to it.
LOW, MARGIN = 0.01, 1 / 2
_RUN = re.compile(r"[^\W\d_]+")
_SLOT_BITS = 22


def letters(text: str | None) -> list[str]:
    """Lower-cased runs of letters; none if the text has no letter."""
    runs = _RUN.findall(text.lower()) if text else []
    return runs if any(c.isalpha() for r in runs for c in r) else []


def gram_hashes(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the n-grams ending at each character of `<word>`, for n = 1 to ORDER; where
    each word starts; and how far each character is from its word's start."""
    text = "<" + "><".join(words) + ">"
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    depth = np.arange(len(code)) - np.repeat(starts, sizes)
    out = [mixed(code + np.uint64(1))]
    for n in range(2, ORDER + 1):
        before = np.concatenate([np.zeros(1, np.uint64), out[-1][:-1]])
        out.append(mixed(before * np.uint64(0x9E3779B97F4A7C15) + code + np.uint64(n)))
    return out, starts, depth


@dataclass
class Model:
    """Flat arrays, which the driver holds and ships; tasks derive the look-ups at first use."""

    languages: list[str]
    listed: pa.Array
    word_scores: np.ndarray
    keys: np.ndarray
    gram_scores: np.ndarray

    @cached_property
    def words(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.listed.to_pylist())}

    @cached_property
    def slots(self) -> np.ndarray:
        out = np.full(1 << _SLOT_BITS, -1, np.int32)
        slot = (self.keys >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        out[slot[::-1]] = np.arange(len(self.keys), dtype=np.int32)[::-1]
        return out

    def unseen(self, words: list[str]) -> np.ndarray:
        """Log posteriors of words that are not in the list."""
        hashes, starts, depth = gram_hashes(words)
        held = np.zeros((len(depth), len(self.languages)), np.float32)
        rest = np.arange(len(depth))
        for n in range(ORDER, 0, -1):
            deep = depth[rest] >= n - 1
            value = hashes[n - 1][rest]
            at = self.slots[(value >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)]
            known = deep & (at >= 0)
            known[known] = self.keys[at[known]] == value[known]
            held[rest[known]] = self.gram_scores[at[known]]
            rest = rest[~known]
        return _posterior(np.add.reduceat(held, starts, axis=0) / ORDER)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        runs = [letters(t) for t in texts]
        flat = [w for r in runs for w in r]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not flat or not self.languages:
            return names, scores
        at = np.fromiter((self.words.get(w, -1) for w in flat), np.int64, len(flat))
        value = np.empty((len(flat), len(self.languages)), np.float32)
        seen = at >= 0
        value[seen] = self.word_scores[at[seen]]
        if not seen.all():
            value[~seen] = self.unseen([flat[i] for i in np.flatnonzero(~seen)])
        full = np.array([i for i, r in enumerate(runs) if r])
        sizes = np.array([len(runs[i]) for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        best = np.add.reduceat(value.astype(np.float64), starts, axis=0).argmax(axis=1)
        chosen = np.exp(value[np.arange(len(flat)), np.repeat(best, sizes)].astype(np.float64))
        share = np.add.reduceat(chosen, starts) / sizes
        for i, b, s in zip(full, best, share, strict=True):
            names[i], scores[i] = self.languages[b], min(1.0, float(s))
        return names, scores


def _posterior(logs: np.ndarray) -> np.ndarray:
    top = logs.max(axis=1, keepdims=True)
    return (logs - top - np.log(np.exp(logs - top).sum(axis=1, keepdims=True))).astype(np.float32)


def _frequencies(found: pa.Table, key: str, languages: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Keys by falling total count, and the log posterior of each language given the key."""
    coded = found[key].combine_chunks().dictionary_encode()
    table = np.zeros((len(coded.dictionary), len(languages)))
    if not len(table):
        return coded.dictionary, table.astype(np.float32)
    lang = pc.index_in(found["lang"], pa.array(languages, pa.string()))
    table[coded.indices.to_numpy(), lang.to_numpy()] = found["c"].to_numpy()
    sums = pa.table({"sum": table.sum(axis=1), "key": coded.dictionary})
    order = pc.sort_indices(sums, [("sum", "descending"), ("key", "ascending")])
    table, total = table[order.to_numpy()], table.sum(axis=0)
    return coded.dictionary.take(order), _posterior(np.log((table + 0.5) / (total + 0.5 * (len(table) + 1))))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (kind 0, by text) and n-grams (kind n, by hash) of a slice, counted by language."""
    for piece in text_slices(batches, "text"):
        words: dict[str, Counter] = {}
        for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(letters(text))
        out: list[tuple] = []
        for lang, counter in words.items():
            out += [(lang, 0, w, 0, c) for w, c in counter.items()]
            if counter:
                hashes, starts, depth = gram_hashes(list(counter))
                weight = np.repeat(np.fromiter(counter.values(), np.int64), np.diff(np.append(starts, len(depth))))
                for n, h in enumerate(hashes, 1):
                    ok = depth >= n - 1
                    keys, inverse = np.unique(h[ok].view(np.int64), return_inverse=True)
                    sums = np.bincount(inverse, weights=weight[ok])
                    out += [(lang, n, "", int(k), int(c)) for k, c in zip(keys, sums, strict=True)]
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "kind", "word", "gram", "c"]
        )


def fit(
    labelled: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample: int = SAMPLE,
    words: int = WORDS,
    grams: int = GRAMS,
) -> Model:
    """The model of the rows whose language is not null. What reaches the driver is bounded by
    `words` and `grams` per language, and stays in Arrow columns there: as Python objects it
    would take several times their room.

    Rows are drawn by a hash of id, text and row place, so repeats of a hot id or text, or rows
    without an id, are in the sample in their share only. A language's threshold is a literal
    of the filter: rows are decided where they are read and no text is shuffled.
    """
    rows = labelled.where(F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"),
        F.pmod(F.xxhash64(doc_id, text, F.monotonically_increasing_id()), F.lit(1_000_000)).alias("draw"),
    )
    below = [x for r in rows.groupBy("lang").count().collect() for x in (F.lit(r.lang), F.lit(1e6 * sample / r["count"]))]
    if not below:
        return Model([], pa.array([], pa.string()), np.zeros((0, 0), np.float32), np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))
    drawn = rows.where(F.col("draw") < F.create_map(*below)[F.col("lang")]).select("lang", "text")
    counts = drawn.mapInArrow(_count_batches, "lang string, kind int, word string, gram bigint, c bigint")
    counts = counts.groupBy("lang", "kind", "word", "gram").agg(F.sum("c").alias("c"))
    order = Window.partitionBy("lang", "kind").orderBy(F.desc("c"), "word", "gram")
    top = counts.withColumn("at", F.row_number().over(order)).where(
        F.when(F.col("kind") == 0, F.col("at") <= words).otherwise(F.col("at") <= grams)
    )
    found = top.select("lang", "kind", "word", "gram", "c").toArrow()
    names = sorted(pc.unique(found["lang"]).to_pylist())
    word_keys, word_scores = _frequencies(found.filter(pc.field("kind") == 0), "word", names)
    by_length = [_frequencies(found.filter(pc.field("kind") == n), "gram", names) for n in range(1, ORDER + 1)]
    keys = np.concatenate([k.to_numpy() for k, _ in by_length]).view(np.uint64)
    return Model(names, word_keys, word_scores, keys, np.concatenate([s for _, s in by_length]))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `docs` in a struct `doc`, with lang_pred and score. The text is the last column."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, "text"):
            names, scores = held.value.predict(piece.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc", "lang_pred", "score"],
            )

    rows = docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, lang_pred string, score double")


def least_scores(held: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> dict[str, float]:
    """For each language of the model, the score below which a text is like none of them.

    Chance is one over the number of languages. The low end of what texts of a language score
    is the `LOW` quantile of all labelled rows of `held`, which the model has not learnt from,
    that are found to be what they are labelled. The least score lies `MARGIN` of the way from
    chance to it, so that the lowest of good texts stay too; and less in the measure that
    held-out rows are told apart no better than by chance, since scores then say nothing. A
    language without such rows gets the quantile of all languages' rows; without any rows it
    is chance.
    """
    rows = held.where(F.col(lang).isin(model.languages)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    found = identify(rows, model).where(F.col("lang_pred") != UNKNOWN).select("doc.lang", "lang_pred", "score")
    right = F.col("lang") == F.col("lang_pred")
    low = F.percentile_approx(F.when(right, F.col("score")), LOW, 10_000)
    of = {r.lang: r for r in found.rollup("lang").agg(low.alias("low"), F.avg(right.cast("int")).alias("told")).collect()}
    chance, told = 1 / max(1, len(model.languages)), [r.told for name, r in of.items() if name is not None]
    skill = max(0.0, (sum(told) / len(told) - chance) / (1 - chance)) if told and chance < 1 else 0.0

    def least(name: str) -> float:
        at = next((of[k].low for k in (name, None) if k in of and of[k].low is not None), chance)
        return min(at, chance + MARGIN * skill * (at - chance))

    return {name: least(name) for name in model.languages}


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether a row belongs to the fold that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))
