r"""Ranked lexical search of many items in all documents at once.

Terms are the maximal runs of ASCII letters and digits and of all signs beyond ASCII, A-Z
lower-cased. Items are taken in blocks of bounded size. For a block, one pass over the texts writes
each document's number of terms and the frequencies of the block's terms; a second, over that
small table, counts the documents of each term. The plan of the block (`sharing`) says which sums
of terms several items share. The third pass lays the weighted frequencies of some hundred
documents side by side, adds up every shared set once, combines the sums along the plan, and keeps
the best documents of each item in its task. Only those meet in a shuffle, in two steps, so that
no task orders more than a bounded number of candidates for an item.

With N documents that have a term, L terms in them, n in one document, of df documents with a term
and tf times in the document, a term adds

    floor(1000 ln((2 N + 2) / (2 df + 1))) * ((10^9 tf) div (1000 tf + 12 m)),  m = 75 + (25 n N) div L

to the score, once for each time it stands in the item.

Defined cases: null or empty texts, and texts without terms, have no terms; such documents count
nowhere and such items have no rows, and so have items whose terms are in no document. Equal scores
go by doc_id, null last; rows that repeat a doc_id are documents of their own, and items that
repeat an item_id each get their ranks. Empty tables give no rows. Ids of documents are integers.
Other columns of either table, whatever their names, do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from curvewise.llm.sharing import Plan, mine
from curvewise.llm.words import text_slices
from curvewise.session import stored

#: A block of items holds at most this many terms, or one item; it bounds what goes to every task.
BLOCK_TERMS = 50_000
#: Numbers in one array of the third pass.
CELLS = 2_000_000
#: Steps of the last shuffle: candidates of an item are cut to the best in so many parts first.
PARTS = 32
#: Every ASCII byte but digits and letters as a space, A-Z as a-z; the bytes of other signs stay.
_TERMS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()

FREQUENCIES = "doc_id bigint, n bigint, terms array<int>, times array<int>"


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split() if text else []


def blocks(items: DataFrame, limit: int) -> Iterator[list[Row]]:
    """The rows of (item_id, text) in blocks of bounded terms; the driver holds one at a time."""
    block: list[Row] = []
    used = 0
    for row in items.toLocalIterator():
        size = len(terms_of(row[1]))
        if not size:
            continue
        if block and used + size > limit:
            yield block
            block, used = [], 0
        block.append(row)
        used += size
    if block:
        yield block


def frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document with terms: n, and the numbers and frequencies of its terms in `vocabulary`.

    `docs` has doc_id and text.
    """
    wide = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in text_slices(batches, "text"):
            words = [terms_of(t) for t in batch.column(1).to_pylist()]
            n = np.fromiter(map(len, words), np.int64, len(words))
            found = np.fromiter((number(w, -1) for ws in words for w in ws), np.int64, int(n.sum()))
            key = (np.repeat(np.arange(n.size), n) * wide + found)[found >= 0]
            key, times = np.unique(key, return_counts=True)
            some = np.flatnonzero(n)
            ends = np.searchsorted(key, (some + 1) * wide)
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(some)),
                    pa.array(n[some]),
                    pa.ListArray.from_arrays(offsets, pa.array(key % wide, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                ],
                ["doc_id", "n", "terms", "times"],
            )

    return docs.mapInArrow(run, FREQUENCIES)


def document_counts(table: DataFrame, wide: int) -> np.ndarray:
    """Documents of each term; tasks send one number per term they met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(wide, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy(), minlength=wide)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(counts[met])], ["term", "df"])

    rows = table.select("terms").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()
    counts = np.zeros(wide, np.int64)
    for row in rows:
        counts[row.term] = row.df
    return counts


class Best:
    """The best documents of each item among those that were offered."""

    def __init__(self, items: int, top: int):
        self.items, self.top = items, top
        self.least = np.ones(items, np.int64)
        self.kept = [np.zeros(0, np.int64)] * 4
        self.waiting: list[list[np.ndarray]] = []
        self.held = 0

    def offer(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """`scores` has a row per item; documents below an item's last kept one are passed over."""
        item, at = np.nonzero(scores >= self.least[:, None])
        self.waiting.append([item, scores[item, at], missing[at], ids[at]])
        self.held += item.size
        if self.held > 2 * self.items * self.top:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        """Item, score, whether the id is null, and id."""
        item, score, missing, ids = (np.concatenate(x) for x in zip(self.kept, *self.waiting, strict=True))
        order = np.lexsort((ids, missing, -score, item))
        item = item[order]
        first = np.searchsorted(item, np.arange(self.items))
        rank = np.arange(item.size) - first[item]
        order, rank, item = order[rank < self.top], rank[rank < self.top], item[rank < self.top]
        self.kept = [item, score[order], missing[order], ids[order]]
        full = rank == self.top - 1
        self.least[item[full]] = self.kept[1][full]
        self.waiting, self.held = [], 0
        return self.kept


def scored(table: DataFrame, plan: Plan, weights: np.ndarray, documents: int, terms: int, items: int, top: int) -> DataFrame:
    """The best documents of each item in every task: item, doc_id, score."""
    width = max(1, CELLS // (weights.size + plan.nodes + plan.flat.size + items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, top)
        for batch in batches:
            ids = batch.column(0)
            missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = ids.fill_null(0).to_numpy()
            m = 75 + 25 * batch.column(1).to_numpy() * documents // terms
            ends = batch.column(2).offsets.to_numpy().astype(np.int64)
            term, times = batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy().astype(np.int64)
            for k in range(0, batch.num_rows, width):
                last = min(k + width, batch.num_rows)
                part = slice(ends[k], ends[last])
                doc = np.repeat(np.arange(last - k), np.diff(ends[k : last + 1]))
                values = np.zeros((weights.size, last - k), np.int64)
                tf = times[part]
                values[term[part], doc] = weights[term[part]] * (1_000_000_000 * tf // (1000 * tf + 12 * m[k:last][doc]))
                best.offer(plan.evaluate(values), ids[k:last], missing[k:last])
        item, score, missing, ids = best.settle()
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=missing > 0), pa.array(score, pa.int64())], ["item", "doc_id", "score"]
        )

    return table.mapInArrow(run, "item int, doc_id bigint, score bigint")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """Ranks of the best documents per item; each step orders a bounded number of rows in a group."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = Window.partitionBy("item", F.pmod(F.hash("doc_id", "score"), F.lit(PARTS))).orderBy(*order)
    first = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)


def rank(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    top: int = 20,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the `top` documents of each item with a score above 0."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    schema = StructType(
        [asked.schema["item_id"], StructField("rank", IntegerType()), StructField("doc_id", LongType()), StructField("score", LongType())]
    )
    found = []
    for block in blocks(asked, block_terms):
        bags = [Counter(terms_of(row.text)) for row in block]
        vocabulary = {term: k for k, term in enumerate(dict.fromkeys(t for bag in bags for t in bag))}
        table = stored(frequencies(texts, vocabulary))
        documents, terms = table.agg(F.count("n"), F.sum("n")).first()
        if not documents:
            break
        counts = document_counts(table, len(vocabulary))
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) if df else 0 for df in counts.tolist()]
        plan = mine([Counter({vocabulary[t]: c for t, c in bag.items() if counts[vocabulary[t]]}) for bag in bags])
        ranked = _ranked(scored(table, plan, np.array(weights, np.int64), documents, terms, len(block), top), top)
        found.append(_named(ranked, [row.item_id for row in block], schema))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def _named(ranked: DataFrame, names: list, schema: StructType) -> DataFrame:
    """Item ids in place of their numbers in the block."""
    kind = to_arrow_type(schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names, kind)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([known.take(batch.column(0)), *batch.columns[1:]], schema.names)

    return ranked.select("item", "rank", "doc_id", "score").mapInArrow(run, schema)
