"""Baselines from daily partial sums, kept up to date a day at a time.

The zero-filled statistics of a type need only ``Σ count`` and ``Σ count²`` over the intervals of
the range, and both add up over days. So a :mod:`eventide.sources.versions` table holds

* per day, the sparse counts ``(type, interval, n)``: the log's size falls to types × intervals;
* per month, a row per type and day: the count of the whole day (for the significance test) and
  ``s`` and ``q`` over the intervals of the day's grid.

A model over any range adds up the month rows of the days that lie whole in the range and reads
the counts of the two days that the range cuts; the event log is not read at all. A day that
arrives late or is corrected is counted again from its own rows and replaces its partial sums
with one published list, so a model sees the old day or the new one.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions.timefmt import STEP_SECONDS, aligned, n_points, ntz
from eventide.operators.baseline import interval_counts, zero_filled_model
from eventide.sources import versions as V

SCHEMA = "day string, metric_key string, interval_ts timestamp_ntz, n bigint, s bigint, q decimal(38,0)"
#: The day of rows without an interval: they count for significance, as in a pass over the log.
UNDATED = "undated"
_MIDNIGHT = datetime(1970, 1, 1)
_PART = "__part"


def _counts_part(day: str) -> str:
    return f"counts-{day}"


def _sums_part(day: str) -> str:
    return f"sums-{day[:7]}"


def rows_of_days(events: DataFrame, days: list[str], ts_col: str = "interval_ts") -> DataFrame:
    """The rows of some days; of a log partitioned by day only their partitions are read."""
    dates = [F.to_date(F.lit(d)) for d in days if d != UNDATED]
    keep = F.to_date(ts_col).isin(dates) if dates else F.lit(False)
    if UNDATED in days:
        return events.filter(keep | F.col(ts_col).isNull())
    if "interval_date" in events.columns:
        events = events.filter(F.col("interval_date").isin(dates))
    return events.filter(keep)


def refresh(spark: SparkSession, root: str, events: DataFrame, cols: list[str], days: list[str] | None = None,
            ts_col: str = "interval_ts", step_seconds: int = STEP_SECONDS) -> V.Snapshot:
    """Count ``days`` (``yyyy-MM-dd``; None: the whole log) of ``events`` and put them in the place of what is stored.

    A listed day without rows is taken out. Days not listed are neither read nor written, but for
    their rows of the partial sums in the same month."""
    base = V.current(spark, root)
    if days is not None:
        events = rows_of_days(events, days, ts_col)
    day = F.coalesce(F.date_format(ts_col, "yyyy-MM-dd"), F.lit(UNDATED))
    counts = interval_counts(events, cols, ts_col).select(
        day.alias("day"), "metric_key", F.col(ts_col).alias("interval_ts"), "n", F.lit(None).cast("bigint").alias("s"),
        F.lit(None).cast("decimal(38,0)").alias("q"), F.concat(F.lit("counts-"), day).alias(_PART))
    fresh = V.stage(counts.repartition(_PART), root, _PART)

    listed = set(days) if days is not None else {p.split("-", 1)[1] for p in [*base.parts, *fresh] if p.startswith("counts-")}
    gone = {_counts_part(d): None for d in listed if _counts_part(d) in base.parts}
    months = {_sums_part(d) for d in listed} | ({p for p in base.parts if p.startswith("sums-")} if days is None else set())
    counted = V.read(spark, root, V.Snapshot(0, fresh, {}), SCHEMA)
    n = F.col("n")
    on_grid = aligned("interval_ts", _MIDNIGHT, step_seconds)
    sums = counted.groupBy("day", "metric_key").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(on_grid, n)), F.lit(0)).alias("s"),
        F.coalesce(F.sum(F.when(on_grid, n.cast("decimal(19,0)") * n)), F.lit(0)).cast("decimal(38,0)").alias("q"))
    kept = V.read(spark, root, base, SCHEMA, sorted(months)).filter(~F.col("day").isin(sorted(listed))) if days is not None else None
    every = sums.select("day", "metric_key", F.lit(None).cast("timestamp_ntz").alias("interval_ts"), "n", "s", "q")
    if kept is not None:
        every = every.unionByName(kept)
    every = every.withColumn(_PART, F.concat(F.lit("sums-"), F.substring("day", 1, 7)))
    monthly = V.stage(every.repartition(_PART), root, _PART)
    gone |= {m: None for m in months if m in base.parts}
    return V.commit(spark, root, base, {**gone, **fresh, **monthly}, {"step_seconds": str(step_seconds)})


def _whole_days(start: datetime, end: datetime, step_seconds: int) -> tuple[str, str]:
    """First and last day all of whose grid points lie in the range (last before first: none)."""
    first = datetime(start.year, start.month, start.day)
    if first < start:
        first += timedelta(days=1)
    last = datetime(end.year, end.month, end.day)
    if last + timedelta(days=1, seconds=-step_seconds) > end:
        last -= timedelta(days=1)
    return f"{first:%Y-%m-%d}", f"{last:%Y-%m-%d}"


def model(spark: SparkSession, root: str, min_total: int, start: datetime, end: datetime,
          step_seconds: int = STEP_SECONDS) -> DataFrame:
    """The model of :func:`eventide.operators.baseline.sparse_model` over ``[start, end]`` from the stored sums."""
    n = n_points(start, end, step_seconds)
    if n < 1:
        raise ValueError("empty spine")
    snap = V.current(spark, root)
    same_grid = int(snap.marks.get("step_seconds", step_seconds)) == step_seconds and (start - _MIDNIGHT).total_seconds() % step_seconds == 0
    low, high = _whole_days(start, end, step_seconds) if same_grid else ("9999", "0000")
    stored = [p for p in snap.parts if p.startswith("counts-") and p != _counts_part(UNDATED)]
    cut = [p for p in stored if f"{start:%Y-%m-%d}" <= p[7:] <= f"{end:%Y-%m-%d}" and not low <= p[7:] <= high]
    whole = F.col("day").between(low, high)
    totals = V.read(spark, root, snap, SCHEMA, [p for p in snap.parts if p.startswith("sums-")]).select(
        "metric_key", F.col("n").alias("total"), F.when(whole, F.col("s")).alias("s"), F.when(whole, F.col("q")).alias("q"))
    c, ts = F.col("n"), F.col("interval_ts")
    edges = (V.read(spark, root, snap, SCHEMA, cut)
             .filter((ts >= ntz(start)) & (ts <= ntz(end)) & aligned(ts, start, step_seconds))
             .select("metric_key", F.lit(0).cast("bigint").alias("total"), c.alias("s"), (c.cast("decimal(19,0)") * c).cast("decimal(38,0)").alias("q")))
    added = (totals.unionByName(edges).groupBy("metric_key")
             .agg(F.sum("total").alias("total"), F.coalesce(F.sum("s"), F.lit(0)).alias("s"),
                  F.coalesce(F.sum("q"), F.lit(0)).cast("decimal(38,0)").alias("q"))
             .filter(F.col("total") > F.lit(min_total)))
    return added.select(*zero_filled_model(n))
