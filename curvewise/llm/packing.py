"""Packing along a space-filling curve.

Each text becomes ids and a hashed bag of ids, projected to a few dimensions; its position
on a Hilbert curve through that space is the sort key. The encoded rows are written once,
range-partitioned by key and sorted; every task joins its stretch of the curve end to end
and cuts it into sequences of `capacity` ids. The last stretch of a task, shorter than a
sequence, is cut into sequences whose lengths are powers of two, which need no padding.
Only ids cross the shuffle, once, and no task holds more than its range and one sequence.

Defined cases: a null or empty text has the end id alone. Rows without an id, and rows that
repeat one, are packed each for itself: `row` tells them apart (a number fixed by the written
table), and also splits a key that very many rows share. An empty table gives no rows. Other
columns of the input do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvewise.llm.hilbert import cells_of, hilbert_keys
from curvewise.llm.tokens import default_paths, encoder
from curvewise.llm.words import mixed, text_slices
from curvewise.session import stored

CAPACITY = 2048
END_ID = 1
#: Hashed vector length, curve dimensions and bits of each dimension.
BUCKETS, DIMS, BITS = 256, 4, 12
#: Ids that one range partition should hold.
PARTITION_IDS = 8_000_000


def curve_keys(bags: np.ndarray) -> np.ndarray:
    """Hilbert positions of hashed id counts, one row for each text."""
    weights = np.log1p(bags)
    norm = np.linalg.norm(weights, axis=1, keepdims=True)
    axes = np.random.default_rng(7).normal(size=(BUCKETS, DIMS))
    return hilbert_keys(cells_of(weights / np.maximum(norm, 1e-12) @ axes, BITS, 4.0), BITS)


def _encode_batches(vocabulary: str, ranks: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, ranks)
        tail = np.array([end], np.uint16).tobytes()
        bucket = (mixed(np.arange(2**16, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
        for piece in text_slices(batches, "text"):
            ids = [(enc.ids(x) if x else b"") + tail for x in piece.column("text").to_pylist()]
            bags = np.stack([np.bincount(bucket[np.frombuffer(x, np.uint16)], minlength=BUCKETS) for x in ids])
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id"),
                    pa.array(curve_keys(bags)),
                    pa.array([len(x) // 2 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["id", "key", "n", "ids"],
            )

    return run


class _Sequences:
    """Lays texts end to end; pieces of the open sequence wait until its length is known."""

    def __init__(self, first: int, capacity: int):
        self.next, self.capacity, self.open, self.used, self.done = first, capacity, [], 0, []

    def _close(self) -> None:
        at = 0
        for row in self.open:
            self.done.append((*row, self.next, at))
            at += row[3]
        self.next, self.open, self.used = self.next + 1, [], 0

    def add(self, number: int, doc: object, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        total = len(ids) if total is None else total
        at = 0
        while at < len(ids):
            size = min(len(ids) - at, self.capacity - self.used)
            self.open.append((doc, number, start + at, size, ids[at : at + size], total))
            self.used += size
            at += size
            if self.used == self.capacity:
                self._close()

    def finish(self) -> None:
        """Cut what is left into sequences of power-of-two lengths, the longest first."""
        rest, left = self.open, self.used
        self.open, self.used, usual = [], 0, self.capacity
        for doc, number, start, size, ids, total in rest:
            at = 0
            while at < size:
                self.capacity = 1 << ((left).bit_length() - 1)
                take = min(size - at, self.capacity - self.used)
                self.open.append((doc, number, start + at, take, ids[at : at + take], total))
                self.used += take
                at += take
                if self.used == self.capacity:
                    left -= self.capacity
                    self._close()
        self.capacity = usual


_PIECE = "doc_id {0}, row bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def _pack_batches(capacity: int):
    def table(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        doc, number, start, size, ids, total, sequence, at = zip(*rows, strict=True) if rows else [()] * 8
        longs = [pa.array(x, pa.int64()) for x in (number, start, size, total, sequence, at)]
        wide = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, id_type), *longs[:3], wide, *longs[3:]],
            names=["doc_id", "row", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Sequences(TaskContext.get().partitionId() << 33, capacity)
        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            for doc, number, ids in zip(*(batch.column(c).to_pylist() for c in ("id", "row", "ids")), strict=True):
                packer.add(number, doc, np.frombuffer(ids, np.uint16))
                if len(packer.done) >= 1000:
                    yield table(packer.done, kind)
                    packer.done = []
        if kind is not None:
            packer.finish()
            yield table(packer.done, kind)

    return run


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    vocabulary: str | None = None,
    ranks: str | None = None,
) -> DataFrame:
    """One row per piece of a text: doc_id, row, start, length, ids (little-endian uint32),
    doc_tokens, sequence_id, offset."""
    usual = default_paths()
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()
    encoded = stored(
        slim.mapInArrow(
            _encode_batches(vocabulary or usual[0], ranks or usual[1], end_id), f"id {id_type}, key bigint, n bigint, ids binary"
        ).withColumn("row", F.monotonically_increasing_id())
    )
    total = encoded.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // PARTITION_IDS))
    return (
        encoded.repartitionByRange(parts, "key", "id", "row")
        .sortWithinPartitions("key", "id", "row")
        .select("id", "row", "ids")
        .mapInArrow(_pack_batches(capacity), _PIECE.format(id_type))
    )
