"""From documents to packed training sequences: language, duplicates, mix, packing.

Each stage takes the rows that the one before kept and returns the columns of documents; the
last returns pieces of sequences. SQL cannot express sketches, recurrent scores or the curve
order, so there is no SQL twin; the tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvewise.llm import exact_dedup, language, mixing, near_dedup, packing
from curvewise.session import stored


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language; those without letters, or whose mean posterior per word
    is far below what held-out documents of the language score, go."""
    unseen = language.held_out("doc_id", 4, 2)
    model = language.fit(docs.where(~unseen))
    least = language.least_scores(docs.where(unseen), model)
    found = language.identify(docs, model).where(F.col("lang_pred") != language.UNKNOWN)
    if least:
        found = found.where(F.col("score") >= F.create_map(*(F.lit(x) for pair in least.items() for x in pair))[F.col("lang_pred")])
    return found.select("doc.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of equal texts."""
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 and more on five-word shingles."""
    return near_dedup.keep_one(docs, size=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, interleaved; small sources begin again, none is cut."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("language", identified),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
