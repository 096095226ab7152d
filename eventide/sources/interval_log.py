"""The interval log: stamped, validated event rows.

Written as headed CSV (the reference's format) or Parquet, partitioned by the interval's
day so reruns overwrite only the days they produce (dynamic partition overwrite) and
readers prune by day. Read back with an explicit schema; nothing is inferred, so codes
keep their leading zeros (Q4).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions.timefmt import ntz, parse_iso_local, stamp_iso_utc
from eventide.plans.views import EVENT_COLUMNS

LOG_COLUMNS = "interval_timestamp string, " + ", ".join(f"{c} string" for c in EVENT_COLUMNS)
LOG_SCHEMA = LOG_COLUMNS + ", interval_date date"
# partition granularity -> (partition column, its type, how it is derived from the interval)
GRANULARITY = {
    "day": ("interval_date", "date", lambda ts: F.to_date(ts)),
    "month": ("interval_month", "string", lambda ts: F.date_format(ts, "yyyy-MM")),
}
# files that a writing task may hold open at once
OPEN_FILES = 64
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def parse_iso_utc(s: Column | str) -> Column:
    """ISO-8601 text with ``Z`` or ``±hh:mm`` to UTC ``timestamp_ntz``, independent of the
    session time zone (F3)."""
    s = F.col(s) if isinstance(s, str) else s
    local = parse_iso_local(s)
    off = F.regexp_extract(s, r"([+-])(\d\d):(\d\d)$", 0)
    sign = F.when(F.substring(off, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    hh = F.regexp_extract(s, r"([+-])(\d\d):(\d\d)$", 2)
    mm = F.regexp_extract(s, r"([+-])(\d\d):(\d\d)$", 3)
    secs = F.when(off == "", F.lit(0)).otherwise(sign * (hh.try_cast("int") * 3600 + mm.try_cast("int") * 60))
    shifted = local - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs.cast("decimal(18,6)"))
    # stamps as the log writes them need no search for an offset
    return F.when(F.substring(s, -6, 6) == "+00:00", local).otherwise(shifted)


def write_interval_log(events: DataFrame, path: str, ts_col: str = "interval_ts", fmt: str = "csv",
                       granularity: str = "day", whole_intervals: bool = False, fresh: bool = False,
                       compression: str | None = None) -> None:
    """Write stamped rows, stamp first, one directory per interval day.

    By default only the partitions present in ``events`` are replaced (dynamic partition
    overwrite), as a rerun over a range needs; ``fresh=True`` is a fresh start, which removes
    every partition of an earlier run first (S7). ``granularity="month"`` suits sparse logs, where day directories would hold tiny files.

    Placement before the write, in one pass over the input: the ``rebalance`` hint lets
    adaptive execution hash rows by partition, split a heavy day over several tasks and
    merge small ones, so files stay near one per partition. ``whole_intervals=True``
    instead range-partitions on (partition, stamp), which never splits an interval across
    files (needed when each landed file must hold whole intervals) at the cost of a
    sampling pass over the input. Rows are placed with their timestamp; the stamp's text is
    made behind the shuffle. A placed task holds few partitions, so it writes to a file of each
    side by side and sorts (and spills) no rows, unless they are more than ``OPEN_FILES``.
    ``compression`` names the codec of the files (``gzip`` makes
    ``*.csv.gz``, which :func:`read_interval_log` takes as it takes plain files).
    """
    part_col, _, derive = GRANULARITY[granularity]
    stamp = stamp_iso_utc("__ts").alias("interval_timestamp")
    out = events.select(F.col(ts_col).alias("__ts"), *EVENT_COLUMNS, derive(F.col(ts_col)).alias(part_col))
    if whole_intervals:
        out = out.select(stamp, *EVENT_COLUMNS, part_col).repartitionByRange(part_col, "interval_timestamp")
    else:
        out = out.hint("rebalance", part_col).select(stamp, *EVENT_COLUMNS, part_col)
    w = (out.write.mode("overwrite").option("partitionOverwriteMode", "static" if fresh else "dynamic")
         .partitionBy(part_col))
    if compression:
        w = w.option("compression", compression)
    if fmt == "csv":
        # the writer trims values unless told not to
        w = w.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    conf = events.sparkSession.conf
    before = conf.get(_WRITERS)
    conf.set(_WRITERS, str(OPEN_FILES))
    try:
        w.format(fmt).save(path)
    finally:
        conf.set(_WRITERS, before)


def read_interval_log(spark: SparkSession, path: str, fmt: str = "csv", granularity: str = "day",
                      start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """All interval files as one frame with ``interval_ts`` parsed (S4, U1). A range
    ``[start, end)`` reads the partitions it touches only."""
    part_col, part_type, _ = GRANULARITY[granularity]
    schema = f"{LOG_COLUMNS}, {part_col} {part_type}"
    if fmt == "csv":
        df = spark.read.schema(schema).option("header", True).csv(path)
    else:
        df = spark.read.schema(schema).parquet(path)
    df = df.withColumn("interval_ts", parse_iso_utc("interval_timestamp"))
    derive = GRANULARITY[granularity][2]
    if start is not None:
        df = df.filter((F.col(part_col) >= derive(ntz(start))) & (F.col("interval_ts") >= ntz(start)))
    if end is not None:
        df = df.filter((F.col(part_col) <= derive(ntz(end))) & (F.col("interval_ts") < ntz(end)))
    return df


# ---------------------------------------------------------------------------
# batch resume marker (S6): a table to which each run adds its newest interval; a run that dies
# while adding leaves the marks of earlier runs, and the newest mark counts
# ---------------------------------------------------------------------------

MARKER_SCHEMA = "last_processed_timestamp timestamp_ntz"


def last_processed(spark: SparkSession, marker: str):
    """The stored high-watermark (``timestamp_ntz``) or ``None`` when nothing ran yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(marker)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema(MARKER_SCHEMA).parquet(marker).agg(F.max("last_processed_timestamp")).head()[0]


def mark_processed(spark: SparkSession, marker: str, processed: DataFrame, ts_col: str = "interval_ts") -> None:
    """Add the newest interval of ``processed`` to the marker (an aggregate, one row; none when a
    run had no rows, so the earlier mark stays)."""
    (processed.agg(F.max(ts_col).cast("timestamp_ntz").alias("last_processed_timestamp"))
     .where("last_processed_timestamp is not null").write.mode("append").parquet(marker))


def unprocessed(spark: SparkSession, log: DataFrame, marker: str, ts_col: str = "interval_ts") -> DataFrame:
    """Rows strictly after the marker; everything when there is no marker. Of a partitioned log the
    partitions before the marker are not read."""
    wm = last_processed(spark, marker)
    if wm is None:
        return log
    for part_col, _, derive in GRANULARITY.values():
        if part_col in log.columns:
            log = log.filter(F.col(part_col) >= derive(F.lit(wm).cast("timestamp_ntz")))
    return log.filter(F.col(ts_col) > F.lit(wm).cast("timestamp_ntz"))
