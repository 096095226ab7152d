"""Inspection helpers: ordered sample rows (S14, O3) and a column profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_rows(df: DataFrame, order_col: str, k: int = 5) -> DataFrame:
    """The first ``k`` rows by a key: a top-k (each task keeps ``k``), never a full sort."""
    return df.orderBy(F.col(order_col)).limit(k)


def column_profile(df: DataFrame, head: int = 5, tail: int = 5) -> DataFrame:
    """Column count and the first row's values of the first ``head`` and last ``tail``
    columns with their ordinals. The first row is the smallest row in column order, found
    by a ``min`` over a struct (a partial aggregate, no sort)."""
    names = df.columns
    n = len(names)
    keep = sorted(set(range(min(head, n))) | set(range(max(0, n - tail), n)))
    first = df.agg(F.min(F.struct(*[F.col(c) for c in names])).alias("r"))
    cells = F.array(*[F.struct(F.lit(i).cast("bigint").alias("ordinal"), F.lit(names[i]).alias("column_name"),
                               F.col(f"r.{names[i]}").cast("string").alias("value")) for i in keep])
    return first.select(F.explode(cells).alias("c")).select(
        "c.ordinal", "c.column_name", "c.value", F.lit(n).cast("bigint").alias("n_columns"))
