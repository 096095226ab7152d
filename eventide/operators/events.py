"""Row-level cleaning of event rows (P3, P4, P7, P8) and interval stamping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions.nulls import is_blank, normalize_na
from eventide.functions.timefmt import floor_interval, stamp_iso_utc, stamp_key


def valid_events(df: DataFrame, text_cols: list[str] | None = None,
                 root_col: str = "event_root_code") -> DataFrame:
    """NA tokens to NULL in the event text columns, then keep rows with a non-empty root code."""
    if text_cols:
        df = normalize_na(df, text_cols)
    return df.filter(F.col(root_col).isNotNull() & (F.col(root_col) != ""))


def accepted_rows(df: DataFrame) -> DataFrame:
    """Rows that become graph elements: both actor names and the event code present."""
    return df.filter(~is_blank("actor1_name") & ~is_blank("actor2_name") & ~is_blank("event_code"))


def stamp_intervals(df: DataFrame, ts: Column | str, first: bool = True) -> DataFrame:
    """Add the interval start and its two text forms, stamp columns first."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    stamped = df.withColumn("interval_ts", floor_interval(ts))
    stamped = (stamped.withColumn("interval_key", stamp_key("interval_ts"))
               .withColumn("interval_timestamp", stamp_iso_utc("interval_ts")))
    if not first:
        return stamped
    lead = ["interval_timestamp", "interval_key", "interval_ts"]
    return stamped.select(*lead, *[c for c in stamped.columns if c not in lead])
