"""Approximate nearest neighbours by cosine along several shifted Hilbert curves.

Each curve takes its own random projection of the unit vectors to a few dimensions, shifted,
and orders the rows by their position along a Hilbert curve through that space. Rows are
range-partitioned by position and get exact ranks from per-partition counts. A query is
compared, with full vectors in double precision, with every row whose rank on a curve lies
within a window of its own; rows stand in blocks of bounded size, and a query visits the
blocks its window touches. The best of all curves are merged.

The window is a share of the index, `MIN_WINDOW` rows at least, so that recall does not fall
as the index grows; on data without any structure (independent directions) it is the share
times the number of curves that decides, see the README for measured recall.

Of equal vectors, the `neighbours` + 1 rows of smallest id stand for all in the index: a row
beyond them can be no answer, since those before it are as near. All rows are queries if the
condition says so.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take
no part, as query or candidate. Vectors of different lengths are never compared. A row without
an id is a candidate, behind others of equal score. Rows that repeat an id are rows of their
own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvewise.llm.hilbert import cells_of, hilbert_keys
from curvewise.session import stored

CURVES, DIMS, BITS = 20, 8, 5
#: Share of the index on each side of a query's rank, and rows at least.
SHARE, MIN_WINDOW = 0.025, 1024
#: Numbers in the vectors of a block, and queries in a list that meets a block.
BLOCK_NUMBERS, LIST_QUERIES = 1 << 18, 512


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def curve_positions(vectors: np.ndarray, curves: int) -> np.ndarray:
    """Positions of the rows on each curve."""
    n = vectors.shape[1]
    dims = min(DIMS, n)
    rng = np.random.default_rng(n)
    scaled = _unit(vectors) * np.sqrt(n)
    out = np.empty((len(vectors), curves), np.int64)
    for c in range(curves):
        axes = np.linalg.qr(rng.normal(size=(n, n)))[0][:, :dims] if n <= 512 else rng.normal(size=(n, dims)) / np.sqrt(n)
        shift = rng.uniform(-0.25, 0.25, dims)
        out[:, c] = hilbert_keys(cells_of(scaled @ axes + shift, BITS, 3.0), BITS)
    return out


def _matrices(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a list column, and the limits of its rows in them."""
    return vectors.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False)))


def _position_batches(curves: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, limits = _matrices(batch.column("vector"))
            sizes = np.diff(limits)
            keys = np.empty((len(sizes), curves), np.int64)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                keys[at] = curve_positions(numbers[limits[at][:, None] + np.arange(n)], curves)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), curves).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "query", "vector", "indexed")), flat],
                names=["id", "query", "vector", "indexed", "keys"],
            )

    return run


def _sides(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each list of (row, id, vector): rows, ids with the largest long for none, matrix."""
    items = lists.flatten()
    rows = items.field("row").to_numpy(zero_copy_only=False)
    ids = items.field("id").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    numbers, limits = _matrices(items.field("vector"))
    at = 0
    for count in lists.value_lengths().to_pylist():
        matrix = numbers[limits[at] : limits[at + count]].reshape(count, -1)
        yield rows[at : at + count], ids[at : at + count], matrix
        at += count


def _best_batches(neighbours: int):
    """The nearest rows of a block for each query of a list.

    One product finds all that may be among the nearest; their scores are then computed pair
    by pair, so that equal vectors get equal scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            scores: list[np.ndarray] = []
            for (q_rows, q_ids, a), (rows, ids, b) in zip(_sides(batch.column("asked")), _sides(batch.column("held")), strict=True):
                a_norm, b_norm = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
                rough = (a @ b.T) / a_norm[:, None] / b_norm
                rough[q_rows[:, None] == rows] = -np.inf
                k = min(neighbours, len(rows))
                floor = np.partition(rough, len(rows) - k, axis=1)[:, len(rows) - k]
                for i in range(len(q_rows)):
                    near = np.flatnonzero((rough[i] >= floor[i] - 1e-9) & np.isfinite(rough[i]))
                    score = (a[i] * b[near]).sum(axis=1) / (a_norm[i] * b_norm[near])
                    best = np.lexsort((rows[near], ids[near], -score))[:neighbours]
                    near = near[best]
                    out.append(np.stack([np.full(len(near), q_rows[i]), np.full(len(near), q_ids[i]), rows[near], ids[near]]))
                    scores.append(score[best])
            found = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
            none = found == np.iinfo(np.int64).max
            columns = [pa.array(x, pa.int64(), mask=m) for x, m in zip(found, none, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())],
                names=["query_row", "query_id", "row", "vec_id", "score"],
            )

    return run


def _ranked(slim: DataFrame, parts: int) -> DataFrame:
    """Exact ranks along each curve: sorted ranges, numbered inside, plus what lies before them."""
    ordered = stored(
        slim.repartitionByRange(parts, "size", "curve", "key", "id", "row")
        .sortWithinPartitions("size", "curve", "key", "id", "row")
        .select("size", "curve", "row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    )
    parted = ordered.groupBy("size", "curve", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("size", "curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parted.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return ordered.join(offsets, ["size", "curve", "part"]).select(
        "size", "curve", "row", (F.col("at") - F.col("first") + F.col("offset")).alias("rank")
    )


def nearest(
    rows: DataFrame,
    is_query: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    neighbours: int = 5,
    curves: int = CURVES,
    share: float = SHARE,
    min_window: int = MIN_WINDOW,
) -> DataFrame:
    """One row per query and neighbour: query_id, rank from 1, vec_id, score, query_row."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    given = rows.select(F.col(vec_id).cast("bigint").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.col(vector).cast("array<double>").alias("vector"))
    same = Window.partitionBy(F.xxhash64("vector"), "vector").orderBy(F.col("id").asc_nulls_last())
    valid = given.where("vector is not null").where(fine)
    copies = valid.withColumn("copy", F.row_number().over(same))
    first = copies.where(F.col("copy") <= neighbours + 1).drop("copy").withColumn("indexed", F.lit(True))
    later = copies.where(F.col("query") & (F.col("copy") > neighbours + 1)).drop("copy").withColumn("indexed", F.lit(False))
    placed = stored(
        first.unionByName(later)
        .mapInArrow(_position_batches(curves), "id bigint, query boolean, vector array<double>, indexed boolean, keys array<bigint>")
        .withColumn("row", F.monotonically_increasing_id())
    )
    entries = placed.select(F.size("vector").alias("size"), F.posexplode("keys").alias("curve", "key"), "id", "row")
    count = placed.count()
    ranks = _ranked(entries, max(1, min(4096, -(-count * curves // 250_000))))
    sizes = placed.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count_if("query").alias("queries"))
    block = F.greatest(F.floor(F.lit(BLOCK_NUMBERS) / F.col("size")), F.lit(64)).cast("bigint")
    window = F.greatest(F.ceil(F.col("n") * share), F.lit(min_window)).cast("bigint")
    located = (
        ranks.join(sizes, "size").withColumn("block", block).withColumn("window", window)
        .join(placed.select("row", "id", "query", "vector", "indexed"), "row")
    )
    item = F.struct("row", "id", "vector")
    held = (
        located.where("indexed")
        .groupBy("size", "curve", F.floor(F.col("rank") / F.col("block")).alias("at"))
        .agg(F.collect_list(item).alias("held"))
    )
    low = F.floor(F.greatest(F.col("rank") - F.col("window"), F.lit(0)) / F.col("block"))
    high = F.floor(F.least(F.col("rank") + F.col("window"), F.col("n") - 1) / F.col("block"))
    expected = (2 * F.col("window") + F.col("block")) * F.col("queries") / F.col("n")
    per_block = F.ceil(expected / LIST_QUERIES)
    asked = (
        located.where("query")
        .select("size", "curve", F.explode(F.sequence(low, high)).alias("at"), F.pmod(F.xxhash64("row"), per_block).alias("part"), item.alias("item"))
        .groupBy("size", "curve", "at", "part")
        .agg(F.collect_list("item").alias("asked"))
    )
    met = asked.join(held, ["size", "curve", "at"]).select("asked", "held")
    found = met.mapInArrow(_best_batches(neighbours), "query_row bigint, query_id bigint, row bigint, vec_id bigint, score double")
    once = found.groupBy("query_row", "query_id", "row", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return (
        once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= neighbours)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "query_row")
    )
