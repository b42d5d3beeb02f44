"""Token counts that follow edits.

A document's pieces are the leaves of a segment tree of lengths and token counts. An edit
touches the leaves it overlaps and the one before it, whose end may move; only these are
encoded again, and the sums above them are renewed.

Defined cases: a null text counts as empty and has 0 tokens. Null edit lists, and null fields
of an edit, leave the text as it is. Edits apply one after another, each to the text that the
earlier ones left; positions are code points, cut to the text's length, and an end before its
start counts as the start. A null replacement deletes. Rows are judged each for itself, so
repeated ids do not matter. An empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvewise.llm.tokens import Encoder, default_paths, encoder, pieces
from curvewise.llm.words import text_slices


class CountTree:
    """Segment tree over the pieces of one text."""

    def __init__(self, text: str, enc: Encoder):
        self.enc, self.encoded = enc, 0
        parts = pieces(text)
        self.leaf = [parts[0], *(" " + p for p in parts[1:])]
        self.size = 1 << max(0, (len(parts) - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(parts), 0] = [len(x) for x in self.leaf]
        self.sums[self.size : self.size + len(parts), 1] = enc.counts(parts)
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2
        self.special = enc.has_special(text)

    @property
    def tokens(self) -> int:
        if self.special:  # a special string may span pieces
            return len(self.enc.full.encode("".join(self.leaf), add_special_tokens=False).ids)
        return int(self.sums[1, 1])

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a position, and where the leaf starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            left = int(self.sums[node, 0])
            if position >= start + left and self.sums[node + 1, 0] > 0:
                start, node = start + left, node + 1
        return node - self.size, start

    def _renew(self, first: int, last: int) -> None:
        low, high = (first + self.size) // 2, (last + self.size) // 2
        while low:
            for node in range(low, high + 1):
                self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
            low, high = low // 2, high // 2

    def edit(self, start: int, end: int, replacement: str) -> None:
        length = int(self.sums[1, 0])
        start = min(max(start, 0), length)
        end = min(max(end, start), length)
        first, at = self._leaf_at(max(start - 1, 0))
        last = self._leaf_at(end - 1)[0] if end > start else first
        old = "".join(self.leaf[first : last + 1])
        new = old[: start - at] + replacement + old[end - at :]
        self.leaf[first : last + 1] = [new] + [""] * (last - first)
        self.sums[self.size + first : self.size + last + 1] = 0
        self.sums[self.size + first] = len(new), len(self.enc.fast.encode_ordinary(new))
        self.encoded += len(new)
        self.special = self.special or self._made_special(first)
        self._renew(first, last)

    def _made_special(self, leaf: int) -> bool:
        """Whether a special string now stands at or about a leaf."""
        longest = max(map(len, self.enc.special), default=0)
        around, i = self.leaf[leaf], leaf
        while i > 0 and len(around) < len(self.leaf[leaf]) + longest:
            i -= 1
            around = self.leaf[i] + around
        i, before = leaf, len(around)
        while i + 1 < len(self.leaf) and len(around) < before + longest:
            i += 1
            around += self.leaf[i]
        return self.enc.has_special(around)


def _count_batches(vocabulary: str, ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, ranks)
        for batch in text_slices(batches, "text"):
            rows = []
            for text, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), strict=True):
                tree = CountTree(text or "", enc)
                before, done = tree.tokens, 0
                for e in edits or ():
                    if e is not None and e["start"] is not None and e["end"] is not None:
                        tree.edit(e["start"], e["end"], e["replacement"] or "")
                        done += 1
                rows.append((before, done, tree.tokens, int(tree.sums[1, 0]), tree.encoded))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(x, pa.int64()) for x in columns)],
                names=["doc_id", "n_tokens", "n_edits", "tokens_after", "chars_after", "chars_encoded_again"],
            )

    return run


def edit(start: Column, end: Column, replacement: Column) -> Column:
    """One edit: the code points from start to before end give way to the replacement."""
    return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), replacement.cast("string").alias("replacement"))


def edited_counts(
    docs: DataFrame,
    edits: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    ranks: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, n_tokens before, n_edits, tokens_after, chars_after and
    chars_encoded_again. `edits` is an array of `edit` structs; no shuffle."""
    usual = default_paths()
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), edits.alias("edits"))
    id_type = slim.schema["id"].dataType.simpleString()
    longs = ", ".join(f"{c} bigint" for c in ("n_tokens", "n_edits", "tokens_after", "chars_after", "chars_encoded_again"))
    return slim.mapInArrow(_count_batches(vocabulary or usual[0], ranks or usual[1]), f"doc_id {id_type}, {longs}")
