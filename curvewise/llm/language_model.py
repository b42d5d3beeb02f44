"""Language-model scores of whole documents.

Token counts come from all training documents and stay distributed. The most frequent tokens,
a bounded number, are broadcast; a document's other tokens meet their counts by a join, so
frequent words never cross the shuffle. A gated recurrent model (`gru`) over the `SHORTLIST`
most frequent tokens and one class for all others is trained in Spark tasks on every token of
every training document once: `ROUNDS` rounds of truncated backpropagation, each over another
part of the documents, whose weights are averaged, element by element, in Spark. Parts are drawn
by id and text together, so rows with one id, or none, are dealt over all rounds. Texts are read
twice, to count and to number their tokens; training and scoring read the stored numbers, two
bytes a token. Only the model, of fixed size, reaches the driver. A token outside the shortlist scores
the model's probability of "other" times its share of the smoothed unigram mass there, so
scores are probabilities over all words, seen or not.

Defined cases: a null or empty text is its end token alone. Rows without an id are training
rows. Repeated rows count as often as they occur and are scored each for itself. Without
training rows every word has the unseen probability. An empty table gives no rows. Any length
of text is scored whole. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvewise.llm import gru
from curvewise.llm.words import text_slices, words_in
from curvewise.session import stored

#: Tokens of the recurrent model; tokens whose counts are broadcast; state size.
SHORTLIST, FREQUENT, HIDDEN = 2048, 200_000, 24
#: Rounds that the training documents are dealt over.
ROUNDS = 3
#: No word holds a blank, so this stands for the end of a text.
END = b"\n"
#: Distinct tokens a task counts before it hands them on.
HELD_TOKENS = 400_000
#: Bytes of text whose tokens are looked up together, as each time the frequent ones are hashed.
SLICE_LOOKED_UP = 12_000_000
#: Bytes of token numbers that are trained on, or scored, together; one document at least.
SLICE_NUMBERS, SLICE_SCORED = 1_500_000, 6_000_000


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows, texts = [], 0, 0

    def merged() -> pa.Table:
        sums = pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("c", "sum")])
        return sums.select(["token", "c_sum"]).rename_columns(["token", "c"])

    for piece in text_slices(batches, "text"):
        met = words_in(piece.column("text"))[0].value_counts()
        held.append(pa.table({"token": met.field("values"), "c": met.field("counts")}))
        rows, texts = rows + len(met), texts + piece.num_rows
        if rows >= 2 * HELD_TOKENS:
            now = merged()
            full = len(now) >= HELD_TOKENS
            if full:
                yield from now.to_batches()
            held, rows = ([], 0) if full else ([now], len(now))
    if texts:
        held.append(pa.table({"token": pa.array([END], pa.binary()), "c": pa.array([texts], pa.int64())}))
        yield from merged().to_batches()


def token_counts(texts: DataFrame) -> DataFrame:
    """Columns token and c over a table with a column text."""
    return texts.select("text").mapInArrow(_count_batches, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


def frequent_tokens(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Up to `most` tokens by falling count: all whose count is above a cut. The cut is found
    from a histogram of count logarithms, so no task sorts or sends more than its share."""
    level = F.floor(F.log2("c") * 64)
    bins = {r.level: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}
    cut, total = None, 0
    for at in sorted(bins, reverse=True):
        total += bins[at]
        if total > most:
            break
        cut = at
    if cut is None:
        return []
    return sorted(((bytes(r.token), r.c) for r in counts.where(level >= cut).collect()), key=lambda x: (-x[1], x[0]))


class Vocabulary:
    """Counts of the frequent tokens, corpus sizes, and numbers of the shortlist's tokens.

    Number 0 is every other token; the shortlist follows by falling count.
    """

    def __init__(self, frequent: list[tuple[bytes, int]], tokens: int, types: int, shortlist: int):
        self.counts = dict(frequent)
        self.unseen = -math.log10(tokens + types + 1)
        self.tokens = tokens
        short = [t for t, _ in frequent[: shortlist - 1]]
        if END in self.counts and END not in short:
            short[-1] = END
        self.number = {t: i for i, t in enumerate(short, 1)}
        self.end = self.number.get(END, 0)
        known = sum((self.counts[t] + 1) / (tokens + types + 1) for t in short)
        self.other = math.log10(max(1 - known, 1 / (tokens + types + 1)))
        self.log_p = np.array([self.other, *(self.log10_p(self.counts[t]) for t in short)]) * math.log(10)

    def log10_p(self, count: int) -> float:
        return math.log10(count + 1) + self.unseen


_NUMBERED = "id {0}, part int, held_out boolean, n_tokens bigint, n_known bigint, base double, other double, rare array<struct<token:binary,tf:bigint>>, numbers binary"


def _bags(of_text: np.ndarray, tokens: pa.Array, texts: int) -> pa.Array:
    """Per text its distinct tokens and their numbers."""
    bags = pa.table({"text": of_text, "token": tokens}).group_by(["text", "token"], use_threads=False).aggregate([([], "count_all")])
    bags = bags.sort_by("text").combine_chunks()
    offsets = np.searchsorted(bags.column("text").to_numpy(), np.arange(texts + 1)).astype(np.int32)
    columns = [pa.concat_arrays([*bags.column(c).chunks, pa.array([], kind)]) for c, kind in (("token", pa.binary()), ("count_all", pa.int64()))]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["token", "tf"]))


def _number_batches(words: Vocabulary):
    """Per row: sums over the tokens whose counts are at hand, the other tokens, and the
    shortlist numbers of all tokens as unsigned 16-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = pa.array(list(words.counts), pa.binary())
        end = next((i for i, t in enumerate(words.counts) if t == END), -1)
        # the last place is for tokens whose counts are not at hand, at -1
        log_p = np.array([*(words.log10_p(c) for c in words.counts.values()), 0.0])
        number = np.array([*(words.number.get(t, 0) for t in words.counts), 0], np.dtype("<u2"))
        for piece in text_slices(batches, "text", SLICE_LOOKED_UP):
            tokens, sizes = words_in(piece.column("text"))
            found = pc.fill_null(pc.index_in(tokens, frequent), -1).to_numpy()
            last = np.cumsum(sizes)
            missing = np.flatnonzero(found < 0)
            of_text, unknown = np.searchsorted(last, missing, side="right"), tokens.take(pa.array(missing))
            if end < 0:  # no training rows: the end token is as unknown as the others
                of_text = np.concatenate([of_text, np.arange(len(sizes))])
                unknown = pa.concat_arrays([unknown, pa.array([END] * len(sizes), pa.binary())])
            rare = _bags(of_text, unknown, len(sizes))
            n, ranks = sizes + 1, np.insert(found, last, end)
            ends = np.cumsum(n)
            starts = ends - n
            values, listed = log_p[ranks], number[ranks]
            base, known = np.add.reduceat(values, starts), np.add.reduceat(ranks >= 0, starts, dtype=np.int64)
            outside = listed == 0
            other = np.add.reduceat(np.where(outside, values, 0.0), starts) - words.other * np.add.reduceat(outside, starts, dtype=np.int64)
            whole = listed.tobytes()
            numbers = [whole[2 * a : 2 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id"), piece.column("part"), piece.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                    pa.array(base, pa.float64()), pa.array(other, pa.float64()), rare, pa.array(numbers, pa.binary()),
                ],
                names=["id", "part", "held_out", "n_tokens", "n_known", "base", "other", "rare", "numbers"],
            )

    return run


def _streams(piece: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in piece.column("numbers").to_pylist()]


def _train_batches(params: gru.Params, end: int):
    """The weights after one pass over the task's documents, and the tokens they saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = params, 0
        for piece in text_slices(batches, "numbers", SLICE_NUMBERS):
            stream = np.concatenate([np.array([end], np.uint16), *_streams(piece)])
            now, seen = gru.train(now, stream, end), seen + len(stream) - 1
        if seen:
            flat = np.concatenate([now[k].reshape(-1) for k in sorted(now)])
            values = pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.float32()), len(flat)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([values, pa.array([seen], pa.int64())], names=["weights", "seen"])

    return run


def fit(numbered: DataFrame, words: Vocabulary, rounds: int = ROUNDS, hidden: int = HIDDEN) -> gru.Params:
    """Rounds of local training and averaging, each over the rows of `numbered` whose `part` is
    its number; so all rows with a part are learnt from once."""
    size = len(words.log_p)
    params = gru.new_params(words.log_p, hidden, max(1, math.isqrt(size)))
    for number in range(rounds):
        part = numbered.where(F.col("part") == number).select("numbers")
        trained = part.mapInArrow(_train_batches(params, words.end), "weights array<float>, seen bigint")
        mean = (
            trained.select("seen", F.posexplode("weights").alias("at", "w"))
            .groupBy("at").agg((F.sum(F.col("w") * F.col("seen")) / F.sum("seen")).alias("w"))
            .orderBy("at").collect()
        )
        if not mean:
            continue
        flat, at = np.array([r.w for r in mean], np.float32), 0
        for k in sorted(params):
            params[k] = flat[at : at + params[k].size].reshape(params[k].shape)
            at += params[k].size
    return params


def _joined(pieces: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring pieces together, up to `limit` bytes in the column: a piece takes as many steps
    as its longest text has tokens."""
    held, used = [], 0
    for piece in pieces:
        size = pc.sum(pc.binary_length(piece.column(column))).as_py() or 0
        if held and used + size > limit:
            yield pa.concat_batches(held)
            held, used = [], 0
        held.append(piece)
        used += size
    if held:
        yield pa.concat_batches(held)


def _score_batches(params: gru.Params, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _joined(text_slices(batches, "numbers", SLICE_SCORED), "numbers", SLICE_SCORED):
            model = gru.log_likelihoods(params, _streams(piece), end) / math.log(10)
            yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(model, pa.float64())], names=["row", "model"])

    return run


def score(docs: DataFrame, held_out: str = "held_out", doc_id: str = "doc_id", text: str = "text", one_in: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows with `held_out` are scored but nothing is learnt from them. A round of training takes
    one in `one_in` of the others, and there are as many rounds.
    """
    slim = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    learnt = slim.where("not held_out")
    counts = stored(token_counts(learnt))
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    words = Vocabulary(frequent_tokens(counts, FREQUENT), size[0], size[1], SHORTLIST)
    id_type = slim.schema["id"].dataType.simpleString()
    part = F.when(~F.col("held_out"), F.pmod(F.xxhash64("id", "text", F.lit(3)), F.lit(one_in)).cast("int"))
    rows = stored(
        slim.select("id", part.alias("part"), "held_out", "text").mapInArrow(_number_batches(words), _NUMBERED.format(id_type))
        .withColumn("row", F.monotonically_increasing_id())
    )
    params = fit(rows, words, one_in)
    model = rows.select("row", "numbers").mapInArrow(_score_batches(params, words.end), "row bigint, model double")
    c = F.coalesce(F.col("c"), F.lit(0))
    rare = (
        rows.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.tf")
        .join(counts.hint("shuffle_hash"), "token", "left")  # one count a token: the tables are even, and nothing is sorted
        .groupBy("row")
        .agg(F.sum(F.col("tf") * (F.log10(c + 1) + words.unseen)).alias("rare_sum"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("rare_known"))
    )
    extra = F.coalesce(F.col("rare_sum"), F.lit(0.0))
    return rows.drop("rare", "numbers").join(model, "row").join(rare, "row", "left").select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce(F.col("rare_known"), F.lit(0))).alias("n_known"),
        F.lit(size[0]).cast("bigint").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"),
        (F.col("model") + F.col("other") + extra).alias("score"),
    )
