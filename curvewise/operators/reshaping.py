"""Labelled unions, long and wide forms, nesting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvewise.operators.joining import attach


def labelled_union(parts: Mapping[str, DataFrame], label: str = "metric") -> DataFrame:
    """Stack tables by name; each part is labelled before it is stacked."""
    out = None
    for name, df in parts.items():
        part = df.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def to_long(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], key: str = "measure", value: str = "value"
) -> DataFrame:
    return df.unpivot(list(ids), list(values), key, value)


def _only_value(y: Column, at: Column, what: str) -> Column:
    picked = F.when(at, y)
    repeated = F.count(F.when(at, F.lit(1))) > 1
    return F.when(repeated, F.raise_error(F.lit(f"more than one row for {what}"))).otherwise(
        F.max(picked)
    )


def to_wide(
    df: DataFrame, keys: Sequence[str], col: str, values: Mapping, y: str
) -> DataFrame:
    """Spread `y` to one column per listed value of `col` (value -> new name).

    One hash aggregation; a key with two rows for the same value is an error.
    """
    spread = [
        _only_value(F.col(y), F.col(col) == F.lit(v), f"{col} = {v}").alias(name)
        for v, name in values.items()
    ]
    return df.groupBy(*keys).agg(*spread)


def nest(df: DataFrame, keys: Sequence[str], max_rows: int = 10_000, data: str = "data") -> DataFrame:
    """One row per group holding its rows as an array of structs.

    Equal rows are first combined to one struct with a `copies` count. A group with
    more than `max_rows` different rows is cut by row hash into several rows,
    numbered by `chunk`, so that no single row has to hold an unbounded group.
    """
    values = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("copies"))
    sizes = rows.groupBy(*keys).agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(max_rows)), F.lit(1)).alias("_chunks")
    )
    marked = attach(rows, sizes, keys).withColumn(
        "chunk", F.pmod(F.xxhash64(*values), F.col("_chunks")).cast("int")
    )
    return marked.groupBy(*keys, "chunk").agg(
        F.sum("copies").alias("n_rows"),
        F.sort_array(F.collect_list(F.struct(*values, "copies"))).alias(data),
    )


def unnest(nested: DataFrame, keys: Sequence[str], data: str = "data") -> DataFrame:
    """The rows of a nested table, copies included."""
    flat = nested.select(*keys, F.inline(data))
    return flat.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop(
        "_i", "copies"
    )
