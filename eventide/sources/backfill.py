"""Day-partitioned backfill (S13, J9): write only the days a table does not have yet.

Present days come from the table's partition column only (no data column is read); the missing days
of the requested calendar are the anti-join; only source rows of missing days are
written, with dynamic partition overwrite, so days already present are never rewritten
and days without rows produce no partition.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators.coverage import missing_days


def existing_days(spark: SparkSession, path: str, day_col: str = "day") -> DataFrame:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], f"{day_col} date")
    return spark.read.parquet(path).select(F.col(day_col).cast("date").alias(day_col)).distinct()


def backfill_days(spark: SparkSession, source: DataFrame, path: str, first: str, last: str,
                  day_col: str = "day") -> DataFrame:
    """Append rows of calendar days in ``[first, last]`` absent from ``path``; returns the
    days that were missing before the write (those without source rows stay missing)."""
    # The calendar is a parameter, so its missing days are a bounded list; fixing it before
    # the write keeps the answer stable and keeps the write from reading its own target.
    todo = sorted(r[0] for r in missing_days(spark, existing_days(spark, path, day_col), first, last, day_col).collect())
    # dates, not their text: a partitioned source is then pruned to those days
    rows = source.filter(F.col(day_col).isin([date.fromisoformat(d) for d in todo]))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(day_col).parquet(path))
    return spark.createDataFrame([(d,) for d in todo], f"{day_col} string")
