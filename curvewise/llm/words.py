"""Words of a text as bytes, their hashes, and slices of Arrow batches by size of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Batches are cut so that the texts of a slice hold at most this many bytes, one text at least.
SLICE_BYTES = 4_000_000
#: A word cache is emptied when it holds this many words.
CACHE_WORDS = 500_000


def words_of(text: str | None) -> list[bytes]:
    r"""Words `[^\x20\x09-\x0D]+` after lower-casing A-Z; bytes methods know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts end to end, as `words_of` gives them, and their number in each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    filled = pc.not_equal(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy()
    return words.filter(filled).cast(pa.binary()), np.diff(before[offsets - offsets[0]])


class WordHashes(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (fixed public constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of bounded text."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        start, used = 0, 0
        for i, size in enumerate(sizes):
            if i > start and used + size > limit:
                yield batch.slice(start, i - start)
                start, used = i, 0
            used += size
        if batch.num_rows > start:
            yield batch.slice(start)

