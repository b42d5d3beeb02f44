r"""Maximal periodic runs of words, found on the diagonals of a text against itself.

Word i meets its earlier occurrence at i - q on the diagonal of lag q. Matches that follow each
other there are a run of period q once they are at least q, and the run with its first period at
least `least` words long. Most words that occur twice lead nowhere, so the diagonals are kept
sparse:

- For lags from l to 2 l the symbol at a word is the stretch of l words that begins there, since a
  diagonal that can become a run matches as long as that. Stretches are named exactly, those of 2 l
  words from the names of two of l words, and only stretches that occur twice in a document go on.
- A diagonal becomes active where a stretch meets an earlier occurrence that follows another word.
  All occurrences that follow the same word are passed over at once: their matches began earlier.
- The match length of an active diagonal grows by the named stretches, longest first, instead of by
  one word at a time. A diagonal that ends with sufficient length is a run; one that ends with a
  multiple of the period has the same first and last word and goes.

Both rules leave a number of active diagonals in proportion to the words, also in a text of one
word repeated. All texts of a slice are worked on in one set of arrays; a word of its own stands
between them.

Words are `[^\x20\x09-\x0D]+`, case kept. Defined cases: a null text counts as empty; a text without
words has no runs and an empty collapsed text. Rows are independent, so repeated rows, null ids and
ties do not matter, and an empty table gives no rows. The other columns of the input, whatever
their names, come back inside the struct `doc`. Runs are ordered by start, then period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from curvewise.llm.words import mixed, text_slices

RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])


class Diagonals:
    """Runs in an array of word numbers, with negative numbers of their own around every text."""

    def __init__(self, ids: np.ndarray, texts: np.ndarray, least: int):
        self.ids, self.texts, self.least = ids, texts, least
        self.base = 1
        while self.base * 2 <= least // 2:
            self.base *= 2
        #: (length of the stretch, name at each word or 0 where it occurs once)
        self.names: list[tuple[int, np.ndarray]] = []

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, length and smallest period of every run, by first word, then period."""
        at, lag = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        size, (place, name) = self.base, self._first_names()
        while place.size:
            begun = self._begun(place, name, 1 if size == self.base else size, 2 * size)
            at.append(begun[0])
            lag.append(begun[1])
            dense = np.zeros(self.ids.size + 1, np.int64)
            dense[place] = name
            self.names.append((size, dense))
            place, name = self._doubled(dense, place, size)
            size *= 2
        i, q = np.concatenate(at), np.concatenate(lag)
        match = self._match(i, i - q)
        enough = match >= np.maximum(q, self.least - q)
        start, length, period = (i - q)[enough], (match + q)[enough], q[enough]
        order = np.lexsort((period, length, start))
        start, length, period = start[order], length[order], period[order]
        again = np.zeros(start.size, bool)
        again[1:] = (start[1:] == start[:-1]) & (length[1:] == length[:-1])
        start, length, period = start[~again], length[~again], period[~again]
        order = np.lexsort((period, start))
        return start[order], length[order], period[order]

    def _first_names(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and names of the stretches of `base` words that occur twice in their text."""
        n = self.ids.size - self.base + 1
        if n <= 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        columns = [self.texts[:n], *(self.ids[k : n + k] for k in range(self.base))]
        key = np.zeros(n, np.uint64)
        for column in columns:
            key = mixed(key * np.uint64(3) + column.astype(np.uint64))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        equal = np.ones(n - 1, bool)
        for column in columns:
            equal &= column[order][1:] == column[order][:-1]
        if (same & ~equal).any():  # two different stretches of one hash: sort the words themselves
            order = np.lexsort(columns[::-1])
            equal = np.ones(n - 1, bool)
            for column in columns:
                equal &= column[order][1:] == column[order][:-1]
        return _repeated(order, equal)

    def _doubled(self, dense: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        later = np.minimum(place + size, self.ids.size)
        place = place[dense[later] > 0]
        if not place.size:
            return place, place
        place = np.sort(place)
        first, second = dense[place], dense[place + size]
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        return _repeated(place[order], (first[1:] == first[:-1]) & (second[1:] == second[:-1]))

    def _begun(self, place: np.ndarray, name: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Words and lags from low to below high where a diagonal becomes active.

        `place` is sorted by name, then place.
        """
        before = self.ids[place - 1]
        block = np.ones(place.size, bool)
        block[1:] = (name[1:] != name[:-1]) | (before[1:] != before[:-1])
        first_of_block = np.maximum.accumulate(np.where(block, np.arange(place.size), 0))
        line = name * (self.ids.size + 1) + place
        group = np.searchsorted(name, name)  # first of the same name
        mine = np.arange(place.size)
        least = np.maximum(np.searchsorted(line, line - high, "right"), group)
        there = np.searchsorted(line, line - low, "right") - 1
        words, lags = [], []
        while mine.size:
            inside = there >= least[mine]
            mine, there = mine[inside], there[inside]
            first = first_of_block[there]
            new = before[there] != before[mine]
            i, last = mine[new], there[new]
            count = last - np.maximum(first[new], least[i]) + 1
            i = np.repeat(i, count)
            back = np.arange(i.size) - np.repeat(np.cumsum(count) - count, count)
            words.append(place[i])
            lags.append(place[i] - place[np.repeat(last, count) - back])
            there = first - 1
        return np.concatenate([np.zeros(0, np.int64), *words]), np.concatenate([np.zeros(0, np.int64), *lags])

    def _match(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on."""
        length = np.zeros(i.size, np.int64)
        for size, dense in reversed(self.names):
            left = dense[np.minimum(i + length, self.ids.size)]
            length += size * ((left > 0) & (left == dense[np.minimum(j + length, self.ids.size)]))
        for _ in range(self.base - 1):
            length += self.ids[i + length] == self.ids[j + length]
        return length


def _repeated(place: np.ndarray, equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places and names from 1, without those that equal neither neighbour."""
    name = np.cumsum(np.concatenate([[1], ~equal]))
    keep = np.append(equal, False) | np.concatenate([[False], equal])
    return place[keep], name[keep]


def runs_of_texts(texts: list[str | None], least: int) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Number of words, runs and collapsed text of each text."""
    words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    edge = np.concatenate([[0], np.cumsum(counts + 1)])
    ids = np.empty(int(edge[-1]) + 1, np.int64)
    number: dict[bytes, int] = {}
    inside = np.ones(ids.size, bool)
    inside[edge] = False
    ids[edge] = -1 - np.arange(edge.size)
    ids[inside] = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64, int(counts.sum()))
    texts_of = np.cumsum(~inside)
    start, length, period = Diagonals(ids, texts_of, least).runs()
    change = np.bincount(start + period, minlength=ids.size + 1) - np.bincount(start + length, minlength=ids.size + 1)
    dropped = np.cumsum(change) > 0
    bounds = np.searchsorted(start, edge)
    out = []
    for k, ws in enumerate(words):
        first = int(edge[k]) + 1
        a, b = int(bounds[k]), int(bounds[k + 1])
        found = list(zip((start[a:b] - first).tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True))
        if found:
            kept = np.flatnonzero(~dropped[first : first + len(ws)]).tolist()
            ws = [ws[i] for i in kept]
        out.append((int(counts[k]), found, b" ".join(ws)))
    return out


def find_runs(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """doc (all other columns), n_words, runs (start, length, period) and collapsed.

    A run has at least `least` words and twice its smallest period, and no neighbouring word
    extends it. Collapsed is the text without the words that lie in a run behind its first
    period, joined by single spaces.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others).alias("doc"), F.col(text).alias("text"))
    schema = StructType(
        [
            rows.schema["doc"],
            StructField("n_words", LongType()),
            StructField("runs", ArrayType(RUN, False)),
            StructField("collapsed", StringType()),
        ]
    )
    kind = pa.list_(pa.field("element", pa.struct([pa.field(n, pa.int64()) for n in RUN.names]), nullable=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            counts, runs, collapsed = zip(*runs_of_texts(batch.column(1).to_pylist(), least), strict=True)
            runs = [[dict(zip(RUN.names, r, strict=True)) for r in found] for found in runs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array([c.decode("utf-8", "surrogatepass") for c in collapsed], pa.string())],
                ["doc", "n_words", "runs", "collapsed"],
            )

    return rows.mapInArrow(run, schema)
