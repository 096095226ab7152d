"""Which intervals or days are absent."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions.timefmt import STEP, day_spine, ntz, spine


def skipped_intervals(spark: SparkSession, loaded: DataFrame, start: datetime, end: datetime,
                      ts_col: str = "interval_ts", step: str = STEP) -> DataFrame:
    """Spine points of ``[start, end)`` with no loaded row (the reference's skip list)."""
    sp = spine(spark, start, end, step, ts_col).filter(F.col(ts_col) < ntz(end))
    # distinct first: a partial aggregate shrinks the loaded rows to one per interval on
    # the map side, so the anti join never shuffles the raw rows (or a hot interval)
    present = (loaded.select(ts_col).filter((F.col(ts_col) >= ntz(start)) & (F.col(ts_col) < ntz(end)))
               .distinct())
    return sp.join(present, ts_col, "left_anti")


def missing_days(spark: SparkSession, present_days: DataFrame, first: str, last: str,
                 day_col: str = "day") -> DataFrame:
    """Calendar days in ``[first, last]`` (``yyyy-MM-dd``) absent from ``present_days``."""
    cal = day_spine(spark, first, last, day_col)
    return (cal.join(present_days.select(day_col).distinct(), day_col, "left_anti")
            .select(F.date_format(day_col, "yyyy-MM-dd").alias(day_col)))
