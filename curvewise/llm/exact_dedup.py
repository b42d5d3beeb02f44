"""Exact duplicates with a heavy-hitter split, in DataFrame functions only.

Texts are compared by the SHA-256 of their normalised form. A Misra-Gries summary of the
digests (`freqItems`, merged from the tasks) holds every digest with more than `support` of
all rows, and at most 1 / support entries. One further pass finds their exact winners. That
table, bounded by 1 / support rows, is broadcast, and rows of heavy groups are decided in
the map tasks. Every other digest has at most `support` of all rows and is shuffled.

Defined cases: a null text counts as empty, and all empty or blank-run texts of equal normal
form are one group. Rows without an id sort after all others; a group of such rows has a
null keep_id. Rows that repeat both id and text count separately, and one of them stays.
An empty table gives no rows. Other columns of the input, whatever their names, do not matter
to `duplicate_groups` and are returned untouched by `keep_first`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvewise.session import stored

#: A group above this share of all rows is heavy; its inverse bounds the broadcast table.
SUPPORT = 0.001


def normalised(text: Column) -> Column:
    """Every run of ASCII blanks as one space; null as the empty text.

    Single spaces are already normal, so the pattern leaves them out.
    """
    return F.regexp_replace(
        F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "
    )


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _order(doc_id: str, row: str) -> Column:
    return F.struct(F.col(doc_id).isNull().alias("a"), F.col(doc_id).alias("b"), F.col(row).alias("c"))


def heavy_winners(slim: DataFrame, support: float) -> DataFrame:
    """Exact winner and size of every digest in the summary; at most 1 / support rows."""
    frequent = slim.stat.freqItems(["digest"], support).select(
        F.explode("digest_freqItems").alias("digest")
    )
    return (
        slim.join(F.broadcast(frequent), "digest")
        .groupBy("digest")
        .agg(F.min(_order("doc_id", "row")).alias("winner"), F.count(F.lit(1)).alias("size"))
    )


def _slim(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Id, digest and a row number that stays fixed because the table is written."""
    return stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            digest(F.col(text)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


def duplicate_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    slim = _slim(docs, doc_id, text)
    winners = stored(heavy_winners(slim, support))
    both = slim.join(F.broadcast(winners), "digest", "left")
    heavy = both.where(F.col("size").isNotNull()).select(
        "doc_id",
        F.col("winner.b").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("winner.c")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    group = Window.partitionBy("digest")
    winner = F.min(_order("doc_id", "row")).over(group)
    light = (
        both.where(F.col("size").isNull())
        .select("doc_id", "digest", "row", winner.alias("best"), F.count(F.lit(1)).over(group).alias("group_size"))
        .select(
            "doc_id",
            F.col("best.b").alias("keep_id"),
            "group_size",
            (F.col("row") == F.col("best.c")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )
    return heavy.unionByName(light)


def keep_first(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT
) -> DataFrame:
    """The rows of `docs` that stay, with all their columns, of any type.

    Rows of heavy groups other than the winner's id are dropped in the map tasks. What is
    left meets by digest; the smallest row in the order of id, then of a hash of the row, is
    combined in the map tasks first, so that repeated rows of one id are no hot key. Rows of
    one id and one hash are taken as one row given twice.
    """
    winners = stored(heavy_winners(_slim(docs, doc_id, text), support)).select(
        "digest", F.col("winner.b").alias("winner_id"), F.lit(True).alias("heavy")
    )
    rows = docs.select(
        digest(F.col(text)).alias("digest"), F.col(doc_id).alias("id"), F.struct("*").alias("row")
    )
    left = rows.join(F.broadcast(winners), "digest", "left").where(
        F.col("heavy").isNull() | F.col("id").eqNullSafe(F.col("winner_id"))
    )
    values = [F.col("row").getField(f.name) for f in docs.schema]
    hashable = [F.to_json(F.struct(v)) if "map<" in f.dataType.simpleString() else v for v, f in zip(values, docs.schema, strict=True)]
    place = F.struct(F.col("id").isNull(), F.col("id"), F.xxhash64(*hashable))
    return left.groupBy("digest").agg(F.min_by("row", place).alias("best")).select("best.*")
