"""Byte-level pair encoding of whole texts and its inverse, with the offset of every token.

A task cuts a slice of texts into pre-tokens (`pretokens`), looks each one up in a cache of
merged pieces, and merges pairs by rank in the pieces that it has not met. Ids and the first byte
of every token are kept side by side as little-endian unsigned 32-bit numbers. Decoding lays the
bytes of each token at its offset, all tokens of a slice at once.

Defined cases: a null text counts as empty, and an empty text has no ids. Rows are independent,
so repeated rows and ids, null ids and ties do not matter; an empty table gives no rows. The other
columns of the input, whatever their names, come back inside the struct `doc`. A piece of any
length is merged whole: short ones side by side in arrays, long ones with a heap. Offsets need texts below
4 GB, more than a row of Spark can hold. Undecodable ids raise an error.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from curvewise.llm import pretokens
from curvewise.llm.tokens import default_paths
from curvewise.llm.words import text_slices

#: The cache is emptied when it holds this many pieces; longer pieces than CACHE_BYTES are not kept.
CACHE_PIECES = 400_000
CACHE_BYTES = 64
#: Pieces up to this many bytes are merged side by side, so many at once; longer ones with a heap.
SCAN_BYTES = 48
SIDE_BY_SIDE = 20_000
#: Slices of texts hold about this many bytes, of text or of ids; a longer text is worked on in parts.
SLICE = 1_000_000
#: Tokens that are laid out at once.
LAID = 200_000


class Merger:
    """Merges pieces by rank; pieces that were seen before come from a cache of their ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        words: list[bytes] = [b""] * self.size
        for word, rank in self.ranks.items():
            words[rank] = word
        #: Bytes of a token by id, end to end, with first byte and length.
        self.lengths = np.fromiter(map(len, words), np.int64, self.size)
        self.firsts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(words), np.uint8)
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        rank = self.ranks.get
        pairs = {
            a * self.size + b: i
            for i, w in enumerate(words)
            for k in range(1, len(w))
            if (a := rank(w[:k])) is not None and (b := rank(w[k:])) is not None
        }
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        self.cache: dict[bytes, bytes] = {}

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit numbers."""
        found = list(map(self.cache.get, pieces))
        missed = {p for p, ids in zip(pieces, found, strict=True) if ids is None}
        if not missed:
            return found
        whole = self.ranks
        new = {p: np.array(self.merge(p), "<u4").tobytes() for p in missed if len(p) > SCAN_BYTES or p in whole}
        short = sorted((p for p in missed if p not in new), key=len)
        for k in range(0, len(short), SIDE_BY_SIDE):
            part = short[k : k + SIDE_BY_SIDE]
            new.update(zip(part, self.merge_many(part), strict=True))
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache.clear()
        self.cache.update((p, ids) for p, ids in new.items() if len(p) <= CACHE_BYTES)
        return [new[p] if ids is None else ids for p, ids in zip(pieces, found, strict=True)]

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that two neighbours merge into, or `size` for none and for the filling -1."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), self.pairs.size - 1)
        return np.where((self.pairs[at] == key) & (right >= 0), self.merged[at], self.size)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Short pieces side by side: each round merges in every piece its leftmost pair of lowest rank."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        tokens = np.full(inside.shape, -1, np.int64)
        tokens[inside] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        pairs = np.full(inside.shape, self.size, np.int64)
        pairs[:, :-1] = self._joined(tokens[:, :-1], tokens[:, 1:])
        done: list[bytes] = [b""] * len(pieces)
        row = np.arange(len(pieces))
        places = np.arange(width)
        while row.size:
            at = pairs.argmin(axis=1)
            best = pairs[np.arange(row.size), at]
            over = best == self.size
            if over.any():
                left = tokens[over]
                ends = (left >= 0).sum(axis=1).tolist()
                flat = left.astype("<u4")
                for r, ids, n in zip(row[over].tolist(), flat, ends, strict=True):
                    done[r] = ids[:n].tobytes()
                row, tokens, pairs, at, best = (x[~over] for x in (row, tokens, pairs, at, best))
                if not row.size:
                    break
            lines = np.arange(row.size)
            source = np.minimum(places + (places > at[:, None]), width - 1)
            last = tokens[:, -1] * 0 - 1
            tokens, pairs = np.take_along_axis(tokens, source, 1), np.take_along_axis(pairs, source, 1)
            tokens[:, -1], pairs[:, -1] = last, self.size
            tokens[lines, at] = best
            after = np.minimum(at + 1, width - 1)
            pairs[lines, at] = np.where(at + 1 < width, self._joined(best, tokens[lines, after]), self.size)
            inner = at > 0
            lines, at, best = lines[inner], at[inner], best[inner]
            pairs[lines, at - 1] = self._joined(tokens[lines, at - 1], best)
        return done

    def merge(self, piece: bytes) -> list[int]:
        """The same merges in one long piece, from a heap of (rank, place); an entry is stale once either side has changed."""
        rank = self.ranks.get
        whole = rank(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1))  # where the part that begins here ends; 0 where none begins
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if end[i] < n and (r := rank(piece[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids and first bytes of the tokens of each text."""
        if len(texts) == 1 and len(texts[0]) > SLICE:
            return self._long(texts[0])
        return self._whole(texts)

    def _whole(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        data, firsts, ends, per_text = pretokens.cut(texts)
        found = self.pieces([data[a:b] for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)])
        ids = np.frombuffer(b"".join(found), "<u4")
        tokens = np.fromiter(map(len, found), np.int64, len(found)) // 4
        last = np.concatenate([[0], np.cumsum(tokens)])[np.cumsum(per_text)]
        first = np.concatenate([[0], last[:-1]])
        size = self.lengths[ids]
        place = np.concatenate([[0], np.cumsum(size)])
        starts = (place[:-1] - np.repeat(place[first], last - first)).astype("<u4")
        bounds = list(zip(first.tolist(), last.tolist(), strict=True))
        return [ids[a:b].tobytes() for a, b in bounds], [starts[a:b].tobytes() for a, b in bounds]

    def _long(self, text: str) -> tuple[list[bytes], list[bytes]]:
        """The same for one long text, in parts that begin with a space between signs that are none."""
        ids, starts, base = [], [], 0
        for part in parts(text, SLICE):
            (a,), (b,) = self._whole([part])
            ids.append(a)
            starts.append((np.frombuffer(b, "<u4") + np.uint32(base)).astype("<u4").tobytes())
            base += len(part.encode("utf-8"))
        return [b"".join(ids)], [b"".join(starts)]

    def decode(self, ids: list[bytes], starts: list[bytes]) -> list[bytes]:
        """The bytes of each text, every token laid at its offset."""
        numbers = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        places = np.frombuffer(b"".join(starts), "<u4").astype(np.int64)
        tokens = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        size = self.lengths[numbers]
        last = np.cumsum(tokens)
        sizes = np.zeros(len(ids), np.int64)
        some = tokens > 0
        sizes[some] = (places + size)[last[some] - 1]
        base = np.cumsum(sizes) - sizes
        places += np.repeat(base, tokens)
        out = np.empty(int(sizes.sum()), np.uint8)
        for k in range(0, numbers.size, LAID):
            n = size[k : k + LAID]
            steps = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(places[k : k + LAID], n) + steps] = self.letters[np.repeat(self.firsts[numbers[k : k + LAID]], n) + steps]
        data = out.tobytes()
        return [data[a : a + n] for a, n in zip(base.tolist(), sizes.tolist(), strict=True)]


def parts(text: str, size: int) -> Iterator[str]:
    """The text in parts of about `size` code points; a pre-token begins wherever one is cut."""
    first = 0
    while len(text) - first > size:
        at = text.find(" ", first + size)
        while at >= 0 and (at + 1 == len(text) or text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[first:at]
        first = at
    yield text[first:]


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    """One for each worker process."""
    return Merger(path)


def encode(docs: DataFrame, text: str = "text", ranks: str | None = None) -> DataFrame:
    """doc (all other columns), ids, starts (first byte of each token), n_tokens."""
    path = ranks or default_paths()[1]
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merger(path)
        for batch in text_slices(batches, "text", SLICE):
            ids, starts = model.encode(batch.column(1).to_pylist())
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(starts, pa.binary()), counts], ["doc", "ids", "starts", "n_tokens"]
            )

    schema = StructType(
        [rows.schema["doc"], StructField("ids", BinaryType()), StructField("starts", BinaryType()), StructField("n_tokens", LongType())]
    )
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """The rows of `encode` with `decoded`, the bytes that the ids stand for, in place of `starts`."""
    path = ranks or default_paths()[1]
    rows = encoded.select("doc", "ids", "starts", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merger(path)
        for batch in text_slices(batches, "ids", SLICE):
            decoded = model.decode(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(decoded, pa.binary()), batch.column(3)], ["doc", "ids", "decoded", "n_tokens"]
            )

    fields = [rows.schema["doc"], rows.schema["ids"], StructField("decoded", BinaryType()), rows.schema["n_tokens"]]
    return rows.mapInArrow(run, StructType(fields))
