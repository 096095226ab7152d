"""Batch runs over the interval log that resume after a crash without losing or repeating a row.

The output of a run and its resume mark are one commit: rows go to a fresh folder, then one rename
publishes both the run's part and the newest interval it has processed
(:mod:`eventide.sources.versions`). A run that dies before the rename has not happened; one that
dies after it is complete. Of two runs started from one mark the second one's commit fails.

Runs are parts of their own, so a reader of one snapshot sees whole runs only, and small ones are
merged by :func:`merge_runs`.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.sources import versions as V
from eventide.sources.interval_log import GRANULARITY

MARK = "last_processed"
_PART = "__run"


def last_processed(snapshot: V.Snapshot) -> datetime | None:
    """The newest interval that a published run has processed."""
    return datetime.fromisoformat(snapshot.marks[MARK]) if MARK in snapshot.marks else None


def after_mark(log: DataFrame, snapshot: V.Snapshot, ts_col: str = "interval_ts") -> DataFrame:
    """Rows after the mark; of a log partitioned by day or month earlier partitions are not read.
    Rows without an interval belong to the first run."""
    mark = last_processed(snapshot)
    if mark is None:
        return log
    at = F.lit(mark).cast("timestamp_ntz")
    for part_col, _, derive in GRANULARITY.values():
        if part_col in log.columns:
            log = log.filter(F.col(part_col) >= derive(at))
    return log.filter(F.col(ts_col) > at)


def run(spark: SparkSession, root: str, log: DataFrame, work: Callable[[DataFrame], DataFrame],
        ts_col: str = "interval_ts") -> V.Snapshot:
    """Process the rows of ``log`` after the mark with ``work`` and publish its rows and the new mark together.

    The mark is taken from the rows handed to ``work``, also where its result leaves some out; without
    new rows nothing is published. ``work`` must keep no state of its own."""
    base = V.current(spark, root)
    new = after_mark(log, base, ts_col)
    newest = new.agg(F.max(ts_col).alias("newest"), F.count(F.lit(1)).alias("rows")).first()
    if not newest["rows"]:
        return base
    # rows that land while this run works are the next one's
    bounded = new if newest["newest"] is None else new.filter(F.col(ts_col).isNull() | (F.col(ts_col) <= F.lit(newest["newest"]).cast("timestamp_ntz")))
    name = f"run-{base.version + 1}"
    parts = V.stage(work(bounded).withColumn(_PART, F.lit(name)), root, _PART)
    mark = newest["newest"] or last_processed(base)
    return V.commit(spark, root, base, parts, {MARK: mark.isoformat()} if mark else {})


def rows(spark: SparkSession, root: str, schema: str, snapshot: V.Snapshot | None = None) -> DataFrame:
    """The rows of all published runs."""
    return V.read(spark, root, V.current(spark, root) if snapshot is None else snapshot, schema)


def merge_runs(spark: SparkSession, root: str, schema: str, least: int = 8) -> V.Snapshot:
    """Once there are ``least`` runs or more, one part for all of them; the mark stays."""
    base = V.current(spark, root)
    runs = [p for p in base.parts if p.startswith("run-")]
    if len(runs) < least:
        return base
    merged = V.read(spark, root, base, schema, runs).withColumn(_PART, F.lit(f"merged-{base.version + 1}"))
    return V.commit(spark, root, base, {**dict.fromkeys(runs), **V.stage(merged.hint("rebalance"), root, _PART)})
