"""Mixing sources to target weights by Pfair windows, in DataFrame functions only.

With W the sum of all weights, the i-th block of a source of weight w (from 0) may not lie
before slot floor(i * W / w) and not at or after ceil((i + 1) * W / w): its release and deadline.
Earliest deadline first among the released keeps every window, so in every prefix of t slots a
source has had more than t * w / W - 1 and less than t * w / W + 1 blocks. Weights are taken as
they are, in integers of any length; nothing is rounded to a period, and no source gets a slot
that its weight does not give. The slots of all blocks of the mix are laid out in order, which
no task can share: the driver does it, holds one entry for each source and `ticks` slots at a
time, and writes them to a table that documents are joined to.

Numbers within a source come from a window over (source, input split) plus what the splits
before it hold, so a source with a third of all rows is spread over its splits.

Nothing is dropped: the mix ends when the last source has given every document once, and
sources that run out earlier begin again, as a new epoch. Default weights are the sources'
sizes to the power `ALPHA`.

Defined cases: a null source is a source of its own. Null ids and texts are ordinary values.
Rows that repeat an id are rows of their own. Sources without rows are ignored; a row whose
source has no weight raises an error before anything is mixed. Any number of sources is mixed.
An empty table gives no rows. Other columns, whatever their names, pass through.
"""

from __future__ import annotations

import heapq
import itertools
import math
import uuid
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvewise.session import shared_folder, stored

#: Slots laid out at a time, documents of a block, flattening of default weights.
TICKS, BLOCK, ALPHA = 500_000, 16, 0.8


def whole_weights(weights: Iterable[float]) -> list[int]:
    """Integers in exactly the proportions of the weights."""
    ratios = [w.as_integer_ratio() for w in weights]
    common = math.lcm(*(d for _, d in ratios))
    return [n * (common // d) for n, d in ratios]


def slots(weights: list[int]) -> Iterator[tuple[int, int]]:
    """Source and number within it of each slot's block, without end: earliest deadline first
    among released blocks. One is always released, since the shares add up to one."""
    total = sum(weights)
    release = [(0, s, 0) for s in range(len(weights))]
    ready: list[tuple[int, int, int]] = []
    for slot in itertools.count():
        while release and release[0][0] <= slot:
            _, s, i = heapq.heappop(release)
            heapq.heappush(ready, (-(-(i + 1) * total // weights[s]), s, i))
        _, s, i = heapq.heappop(ready)
        yield s, i
        heapq.heappush(release, ((i + 1) * total // weights[s], s, i + 1))


def period(shares: list[int]) -> list[int]:
    """The source of each slot of one period of whole shares."""
    return [s for s, _ in itertools.islice(slots(shares), sum(shares))]


def until_given(weights: list[int], needed: list[int]) -> Iterator[tuple[int, int]]:
    """The slots until each source has given the blocks it needs."""
    missing = len(needed)
    for s, i in slots(weights):
        yield s, i
        missing -= i + 1 == needed[s]
        if not missing:
            return


def _laid_out(spark: SparkSession, keys: list[int], laid: Iterator[tuple[int, int]], ticks: int) -> DataFrame:
    """Columns s, block and slot of all blocks, written `ticks` slots at a time."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    start = 0
    for part in itertools.batched(laid, ticks):
        columns = [
            pa.array([keys[s] for s, _ in part], pa.int64()), pa.array([i for _, i in part], pa.int64()),
            pa.array(range(start, start + len(part)), pa.int64()),
        ]
        rows = spark.createDataFrame(pa.Table.from_arrays(columns, names=["s", "block", "slot"]))
        rows.write.option("compression", "zstd").mode("append").parquet(path)
        start += len(part)
    return spark.read.schema("s bigint, block bigint, slot bigint").parquet(path)


def _weighted(sources: DataFrame, weights: Mapping) -> DataFrame:
    """The sources with the column w of their weights."""
    table = pa.table({"of": pa.array(list(weights), pa.string()), "w": pa.array([float(w) for w in weights.values()], pa.float64())})
    wanted = sources.sparkSession.createDataFrame(table)
    found = stored(sources.join(wanted, F.col("name").eqNullSafe(F.col("of")), "left").drop("of"))
    if missing := found.where("w is null").select("name").limit(20).collect():
        raise ValueError(f"no weight for sources {sorted(str(r.name) for r in missing)}")
    return found


def mix(
    docs: DataFrame,
    source: str = "source",
    weights: Mapping | None = None,
    ticks: int = TICKS,
    block: int = BLOCK,
) -> DataFrame:
    """Columns doc (a struct of the input's columns), source, epoch from 0, position from 0.

    Positions are gapless. `weights` maps source names (as strings, None for null) to weights.
    `ticks` bounds what the driver holds; the result does not depend on it.
    """
    spark = docs.sparkSession
    rows = stored(
        docs.select(
            F.struct("*").alias("doc"), F.col(source).cast("string").alias("source"),
            F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"),
        )
    )
    parts = stored(rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("c")))
    in_order = parts.groupBy(F.col("source").alias("name")).agg(F.sum("c").alias("n")).orderBy(F.col("name").asc_nulls_first())
    sources = stored(in_order.withColumn("s", F.monotonically_increasing_id()))
    weighted = sources.withColumn("w", F.lit(None).cast("double")) if weights is None else _weighted(sources, weights)
    sizes = weighted.select("s", "n", "w").toArrow().sort_by("s").to_pydict()
    keys, counts = sizes["s"], sizes["n"]
    if not keys:
        return rows.select("doc", "source", F.lit(0).alias("epoch"), F.col("row").alias("position"))
    wanted = sizes["w"] if weights is not None else [n**ALPHA for n in counts]
    if any(not 0 < w < math.inf for w in wanted):
        raise ValueError("weights must be positive")
    pattern = _laid_out(spark, keys, until_given(whole_weights(wanted), [-(-n // block) for n in counts]), ticks)
    given = pattern.groupBy("s").agg(F.count(F.lit(1)).alias("blocks"))
    of_source = stored(sources.join(given, "s"))
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.join(of_source, F.col("source").eqNullSafe(F.col("name"))).drop("source")
        .withColumn("offset", F.coalesce(F.sum("c").over(before), F.lit(0)))
        .select("s", "part", "n", "blocks", "offset")
    )
    numbered = rows.join(of_source.select("s", "name"), F.col("source").eqNullSafe(F.col("name"))).withColumn(
        "number", F.row_number().over(Window.partitionBy("s", "part").orderBy("row")) - 1
    ).select("doc", "source", "s", "part", "number")
    placed = numbered.join(offsets, ["s", "part"]).withColumn("number", F.col("number") + F.col("offset"))
    last = F.expr(f"(blocks * {block} - 1 - number) div n")
    epochs = placed.where(F.col("number") < F.col("blocks") * block).withColumn("epoch", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    at = epochs.withColumn("at", F.col("epoch") * F.col("n") + F.col("number")).withColumn("block", F.expr(f"at div {block}"))
    slotted = at.join(pattern, ["s", "block"])
    return slotted.select("doc", "source", "epoch", (F.col("slot") * block + F.col("at") % block).alias("position"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with the columns of `docs`, in the order of their positions."""
    mixed = mix(docs, **options).select("doc", "position")
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select("doc.*")
