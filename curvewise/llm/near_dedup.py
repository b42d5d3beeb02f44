"""Near duplicates: fast similarity sketches, banding, exact checks, connected components.

A document is the set of its distinct word shingles, held as 64-bit hashes. Documents with
one and the same set are one node, so that copies never meet pair by pair.

Sketch: a fast similarity sketch with T coordinates. In round i of the first T rounds every
element goes to a hashed coordinate, in round T + j to coordinate j; a coordinate keeps its
smallest (round, value). After 2 T rounds at the latest every coordinate is filled, usually
in a few, and the share of equal coordinates is concentrated about the Jaccard similarity.

Links: nodes that agree in a band meet in a bucket. First every member is checked, on full
sets, against up to `HUBS` members, the first in as many hashed orders, which are the same in
all buckets. After components are known, members of a bucket that still lie in different
components are compared in blocks: by their sketches, and where these are close and the pair
is not yet connected, on full sets. A pair is looked at in the first band it shares only, which
is told from the whole band keys. So no bucket is expanded into all its pairs, and no link is left out because of a bucket's size: pairs that are not compared are already in
one component. A link of similarity s is missed only if no band agrees: (1 - s^ROWS)^BANDS,
5e-8 at s = 0.8, or if the sketch estimate is under SURE, five deviations below 0.8.

Defined cases: null, empty and blank texts have an empty set, are linked with nothing and
are kept. A text with fewer words than a shingle is one shingle. Rows without an id take
part; a component of such rows alone has a null component_id, and they are kept. Rows that
repeat an id are judged each by its own text. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvewise.llm.components import connected
from curvewise.llm.words import WordHashes, mixed, text_slices, words_of
from curvewise.session import stored

BANDS, ROWS = 32, 4
T = BANDS * ROWS
#: Shingles that are placed in their bins together; bounds the memory of very long texts.
CHUNK = 65_536
#: Members of a bucket that all others are checked against first.
HUBS = 8
#: A pair is left unchecked only if the share of equal sketch coordinates is below this.
SURE = 0.62
#: Members of a bucket, and their shingles, that are compared with each other at a time, about.
BLOCK, BLOCK_SHINGLES = 256, 1_000_000


def shingle_hashes(text: str | None, hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of `size` words."""
    word = hashes.array(words_of(text))
    if not len(word):
        return word
    size = min(size, len(word))
    count = len(word) - size + 1
    value = np.full(count, size, np.uint64)
    for i in range(size):
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + word[i : i + count])
    return np.unique(value)


def sketches(sets: list[np.ndarray], coordinates: int = T) -> np.ndarray:
    """Fast similarity sketches of non-empty sets, one row each."""
    full = np.uint64(2**64 - 1)
    out = np.full((len(sets), coordinates), full)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for step in range(2 * coordinates):
        if not len(value):
            break
        for at in range(0, len(value), CHUNK):
            x = mixed(value[at : at + CHUNK] + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % 2**64))
            item = (np.uint64(step) << np.uint64(40)) | (x & np.uint64(2**40 - 1))
            if step < coordinates:
                place = ((x >> np.uint64(40)) * np.uint64(coordinates)) >> np.uint64(24)
            else:
                place = np.full(len(x), step - coordinates, np.uint64)
            np.minimum.at(flat, owner[at : at + CHUNK] * coordinates + place.astype(np.int64), item)
        open_sets = (out == full).any(axis=1)
        keep = open_sets[owner]
        if not keep.all():
            owner, value = owner[keep], value[keep]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different for equal values in different bands."""
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sketch), BANDS)).copy()
    for r in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sketch[:, r * BANDS : (r + 1) * BANDS])
    return key.view(np.int64)


def _sketch_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for piece in text_slices(batches, "text"):
            sets = [shingle_hashes(x, hashes, size) for x in piece.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            rows = sketches([sets[i] for i in full])
            keys, small = band_keys(rows), mixed(rows).astype(np.uint8)
            bands, short, node = ([None] * len(sets) for _ in range(3))
            for k, i in enumerate(full):
                bands[i], short[i] = keys[k], small[k].tobytes()
                node[i] = xxhash.xxh128_digest(sets[i].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id"),
                    piece.column("mark"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(node, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(short, pa.binary()),
                ],
                names=["id", "mark", "n", "node", "bands", "sketch"],
            )

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, in integers."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _check_batches(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        last, base = None, np.zeros(0, np.uint64)
        for piece in text_slices(batches, "text"):
            keep = []
            rows = zip(*(piece.column(c).to_pylist() for c in ("a", "base", "text")), strict=True)
            for i, (node, base_text, text) in enumerate(rows):
                if node != last:
                    last, base = node, shingle_hashes(base_text, hashes, size)
                if linked(base, shingle_hashes(text, hashes, size), percent):
                    keep.append(i)
            yield piece.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _block_batches(size: int, percent: int):
    """Links between two blocks of one bucket that join components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("same", "left", "right"))
            for same, left, right in zip(*columns, strict=True):
                out += _block_links(same, left, right, hashes, size, percent)
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def _block_links(same: bool, left: list, right: list, hashes: WordHashes, size: int, percent: int) -> list[tuple]:
    """`before` of a row holds its keys of the bands before the bucket's: a pair that agrees in
    one of them has met in that band's bucket."""
    x, y = (np.frombuffer(b"".join(r["sketch"] for r in side), np.uint8).reshape(-1, T) for side in (left, right))
    p, q = (np.array([r["before"] for r in side], np.int64) for side in (left, right))
    roots, n = np.array([r["root"] for r in right], object), np.array([r["n"] for r in right])
    sets: dict[bytes, np.ndarray] = {}
    merged: dict[bytes, bytes] = {}

    def shingles(row: dict) -> np.ndarray:
        if row["node"] not in sets:
            sets[row["node"]] = shingle_hashes(row["text"], hashes, size)
        return sets[row["node"]]

    def root(r: bytes) -> bytes:
        while r in merged:
            r = merged[r]
        return r

    out = []
    for i, row in enumerate(left):
        equal = x[i] == y
        fits = 100 * np.minimum(n, row["n"]) >= percent * np.maximum(n, row["n"])
        near = np.flatnonzero(fits & (roots != row["root"]) & (equal.mean(axis=1) >= SURE))
        met = (p[i] == q[near]).any(axis=1)
        for j in near[~met]:
            r, s = root(row["root"]), root(roots[j])
            if r != s and not (same and j <= i) and linked(shingles(row), shingles(right[j]), percent):
                merged[max(r, s)] = min(r, s)
                out.append((min(row["node"], right[j]["node"]), max(row["node"], right[j]["node"])))
    return out


def _checked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets are linked. `texts` has one text for each node."""
    base = texts.select(F.col("node").alias("a"), F.col("text").alias("base"))
    other = texts.select(F.col("node").alias("b"), "text")
    return stored(
        pairs.join(other, "b").join(base, "a").select("a", "b", "base", "text")
        .mapInArrow(_check_batches(size, percent), "a binary, b binary")
    )


def _late_links(members: DataFrame, roots: DataFrame, nodes: DataFrame, slim: DataFrame, size: int, percent: int) -> DataFrame:
    """Links inside buckets that still hold several components."""
    placed = members.where("members > 2").join(roots, "node", "left").select(
        "bucket", "band", "node", "n", F.coalesce("root", "node").alias("root")
    )
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES))
    split = (
        placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), blocks.alias("blocks"))
        .where("low <> high").select("bucket", "blocks")
    )
    open_rows = stored(placed.join(split, "bucket"))
    texts = _texts(slim, nodes, open_rows.select("node").distinct()).join(nodes.select("node", "sketch", "bands"), "node")
    lists = stored(
        open_rows.join(texts, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("before", F.slice("bands", F.lit(1), F.col("band")))
        .groupBy("bucket", "blocks", "block")
        .agg(F.collect_list(F.struct("node", "root", "n", "sketch", "before", "text")).alias("rows"))
    )
    other = F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))
    left = lists.select("bucket", "block", F.col("rows").alias("left"), other.alias("other"))
    right = lists.select("bucket", F.col("block").alias("other"), F.col("rows").alias("right"))
    met = left.join(right, ["bucket", "other"]).select((F.col("block") == F.col("other")).alias("same"), "left", "right")
    return stored(met.mapInArrow(_block_batches(size, percent), "a binary, b binary"))


def near_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept (its id is the component's),
    stays (the one row of the component, told by id and text), node (its set's key), mark."""
    slim = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()
    drawn = stored(
        slim.mapInArrow(_sketch_batches(size), f"id {id_type}, mark bigint, n bigint, node binary, bands array<bigint>, sketch binary")
    )
    held = drawn.where("node is not null")
    nodes = stored(
        held.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "mark")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    )
    in_band = nodes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    first = [F.min(F.struct(F.xxhash64("node", F.lit(j)).alias("h"), F.struct("node", "n").alias("hub"))) for j in range(HUBS)]
    size_up = (
        in_band.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.array(*first).alias("first")).where("members > 1")
        .select("bucket", "members", F.array_distinct("first.hub").alias("hubs"))
    )
    members = stored(in_band.join(size_up, "bucket").select("bucket", "band", "node", "n", "members", "hubs"))
    ends = members.select("node", "n", F.explode("hubs").alias("end"))
    pairs = stored(
        ends.where(F.col("node") != F.col("end.node"))
        .where(100 * F.least("n", "end.n") >= percent * F.greatest("n", "end.n"))
        .select(F.least("node", "end.node").alias("a"), F.greatest("node", "end.node").alias("b"))
        .distinct()
    )
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = _texts(slim, nodes, wanted)
    links = _checked(pairs, texts, size, percent)
    roots = stored(connected(links))
    more = _late_links(members.select("bucket", "band", "node", "n", "members"), roots, nodes, slim, size, percent)
    if not more.isEmpty():
        roots = stored(connected(links.unionByName(more)))
    named = nodes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    winners = named.groupBy("root").agg(F.min("first").alias("winner"))
    of_node = named.join(winners, "root").select("node", "winner")
    alone = F.col("node").isNull()
    return (
        drawn.select("id", "mark", "n", "node").join(of_node, "node", "left")
        .select(
            F.col("id").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.when(alone, F.col("id")).otherwise(F.col("winner.id")).alias("component_id"),
            (alone | (F.col("id").eqNullSafe(F.col("winner.id")) & (F.col("mark") == F.col("winner.mark")))).alias("stays"),
            "node",
            "mark",
        )
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "stays", "node", "mark")
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one of each group, and whatever
    has no words. Rows that repeat both id and text stay or go together."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("mark"), F.struct("*").alias("doc"))
    gone = near_groups(docs, doc_id, text, size, percent).where("not stays").select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    same = (rows["mark"] == gone["gone_mark"]) & rows["id"].eqNullSafe(gone["gone_id"])
    return rows.join(gone, same, "left_anti").select("doc.*")


def _texts(slim: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text for each wanted node; `mark` tells rows apart that repeat an id."""
    chosen = nodes.join(wanted, "node").select("node", F.col("first.id").alias("id"), F.col("first.mark").alias("mark"))
    same = (slim["mark"] == chosen["mark"]) & slim["id"].eqNullSafe(chosen["id"])
    return slim.join(chosen, same).select("node", "text").groupBy("node").agg(F.first("text").alias("text"))
