"""Reading observation tables and writing trait tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_observations(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    na: str = "NA",
    all_string: bool = False,
) -> DataFrame:
    """Read a CSV with a header; `na` is the null token.

    Header dots become underscores so that columns need no back-quotes. With
    `all_string` every column stays text, to be repaired later with `try_cast`.
    A given `schema` saves the inference pass and should be passed for big inputs.
    Line ends may be LF, CR or CRLF.
    """
    reader = spark.read.option("header", True).option("nullValue", na)
    if schema is not None:
        df = reader.schema(schema).csv(path)
    else:
        df = reader.option("inferSchema", not all_string).csv(path)
    return df.toDF(*[c.replace(".", "_") for c in df.columns])


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Read a parquet table, optionally only some columns."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None
) -> None:
    """Write a derived table; CSV keeps the header and the NA token."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "NA").csv(path)
    else:
        writer.format(fmt).save(path)
