"""Missing-value handling for text exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tokens a pandas CSV reader turns into a missing value by default
# (the reference reads its exports with those defaults). The empty string is included.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]


def na_to_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def normalize_na(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replace NA tokens by NULL in the given string columns, keep column order."""
    wanted = set(cols)
    return df.select(*[na_to_null(c).alias(c) if c in wanted else F.col(c) for c in df.columns])


def is_blank(c: Column | str) -> Column:
    """Python truthiness of an optional string: NULL or '' is false."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit("")) == ""


def na_sql(col: str) -> str:
    """DuckDB twin of :func:`na_to_null` for the oracle."""
    toks = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)
    return f"CASE WHEN {col} IN ({toks}) THEN NULL ELSE {col} END"
