"""Time helpers (interval floor, stamp formats, spines). All work on timestamp_ntz or
timestamp columns without depending on the session time zone."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = "15 minutes"
STEP_SECONDS = 15 * 60


def step_seconds(step: str) -> int:
    """Length of a step such as ``15 minutes``, which must divide a day."""
    n, unit = step.split()
    seconds = int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    if seconds <= 0 or 86400 % seconds:
        raise ValueError(f"{step} does not divide a day")
    return seconds


def floor_interval(ts: Column | str, step: str = STEP) -> Column:
    """Floor a timestamp to the start of its tumbling interval (F1); NULL stays NULL (a
    ``window`` expression would drop such rows)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    in_day = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.date_part(F.lit("SECOND"), ts)
    past = in_day.cast("decimal(18,6)") % F.lit(step_seconds(step)).cast("decimal(18,6)")
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), past)


def stamp_key(ts: Column | str) -> Column:
    """``YYYYMMDDHHMMSS`` form used in export file names (F2)."""
    return F.date_format(ts, "yyyyMMddHHmmss")


def stamp_iso_utc(ts: Column | str) -> Column:
    """ISO-8601 with an explicit UTC offset, e.g. ``2024-01-01T00:15:00+00:00``."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def _num(s: Column, start: int, length: int) -> Column:
    return F.substring(s, start, length).try_cast("int")


def _ntz_from_parts(s: Column, pos: list[int], lens: list[int]) -> Column:
    """``timestamp_ntz`` from fixed-position digit fields; malformed text gives NULL (no
    error under ANSI mode)."""
    parts = [_num(s, p, n) for p, n in zip(pos, lens)]
    while len(parts) < 6:
        parts.append(F.lit(0))
    return F.try_make_timestamp_ntz(*parts)


def parse_stamp_key(s: Column | str) -> Column:
    """Inverse of :func:`stamp_key` giving ``timestamp_ntz``; NULL when malformed."""
    s = F.col(s) if isinstance(s, str) else s
    return F.when(s.rlike(r"^\d{14}$"), _ntz_from_parts(s, [1, 5, 7, 9, 11, 13], [4, 2, 2, 2, 2, 2]))


def parse_day(s: Column | str) -> Column:
    """``yyyyMMdd`` text to a date; NULL when malformed."""
    s = F.col(s) if isinstance(s, str) else s
    return F.try_to_date(s, "yyyyMMdd")


def day_start(s: Column | str) -> Column:
    """``yyyyMMdd`` text to the ``timestamp_ntz`` of that midnight; NULL when malformed."""
    s = F.col(s) if isinstance(s, str) else s
    return F.when(s.rlike(r"^\d{8}$"), _ntz_from_parts(s, [1, 5, 7], [4, 2, 2]))


def parse_iso_local(s: Column | str) -> Column:
    """The ``yyyy-MM-ddTHH:mm:ss`` part of ISO-8601 text as ``timestamp_ntz``."""
    s = F.col(s) if isinstance(s, str) else s
    return F.when(s.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d"),
                  _ntz_from_parts(s, [1, 6, 9, 12, 15, 18], [4, 2, 2, 2, 2, 2]))


def stamp_from_path(path_col: Column | str) -> Column:
    """Interval stamp taken from the 14-digit timestamp in a file name (P5 at scale);
    NULL when the name has none."""
    key = F.regexp_extract(path_col, r"(\d{14})[^/]*$", 1)
    return F.when(key != "", parse_stamp_key(key))


def n_points(start: datetime, end: datetime, step_seconds: int = STEP_SECONDS) -> int:
    """Number of points of the inclusive spine ``start, start+step, ... <= end``."""
    if end < start:
        return 0
    return int((end - start).total_seconds() // step_seconds) + 1


def spine(spark: SparkSession, start: datetime, end: datetime, step: str = STEP,
          name: str = "interval_ts") -> DataFrame:
    """Inclusive time spine as a one-column frame (D5). Points come from ``spark.range``,
    so they are generated in parallel; the row count grows with the range only."""
    seconds = step_seconds(step)
    n = n_points(start, end, seconds)
    return spark.range(n).select(
        (ntz(start) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                         (F.col("id") * seconds).cast("decimal(18,6)"))).alias(name))


def day_spine(spark: SparkSession, first: str, last: str, name: str = "day") -> DataFrame:
    """Inclusive calendar of dates between two ``yyyy-MM-dd`` strings (parallel rows)."""
    d0 = datetime.strptime(first, "%Y-%m-%d")
    n = (datetime.strptime(last, "%Y-%m-%d") - d0).days + 1
    return spark.range(max(n, 0)).select(F.date_add(F.to_date(F.lit(first)), F.col("id").cast("int")).alias(name))


def aligned(ts: Column | str, start: datetime, step_seconds: int = STEP_SECONDS) -> Column:
    """True when ``ts`` is a spine point of a spine starting at ``start``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    secs = F.timestamp_diff("SECOND", ntz(start), ts)
    return F.pmod(secs, F.lit(step_seconds)) == 0


def ntz(value: datetime) -> Column:
    """A ``timestamp_ntz`` literal; independent of driver and session time zones."""
    return F.expr(f"TIMESTAMP_NTZ'{value:%Y-%m-%d %H:%M:%S}'")


def sql_ts(value: datetime) -> str:
    return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S}'"


def days_before(day_yyyymmdd: str, days: int) -> str:
    d = datetime.strptime(day_yyyymmdd, "%Y%m%d") - timedelta(days=days)
    return d.strftime("%Y%m%d")
