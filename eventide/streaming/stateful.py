"""Interval scoring by streaming state alone, with restatement (T2, T3, T6), and counters of streams.

One streaming query: landed rows are counted per (type, interval) by a watermarked streaming
aggregation in update mode, joined with the model (a static side, so the optimizer picks the join by
its size) and scored. When a later file brings more rows of an interval, its state's new counts come
out again, so the newer score takes the older one's place: an alert that no longer holds is taken
back by a row that says so. State of intervals behind the watermark is dropped, and rows behind it
are counted as late. :func:`eventide.streaming.detect.start_interval_alerts` re-sums stored counts instead.

Each batch's rows are written under its id, so a replayed batch replaces its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from eventide.functions.text import metric_key
from eventide.operators.events import valid_events
from eventide.streaming.ingest import landed_interval_files

SCORE_SCHEMA = ("interval_ts timestamp_ntz, metric_key string, current_count bigint, mean double, std_dev double, "
                "z_score double, is_alert boolean, batch_id bigint")
COUNTER_SCHEMA = "query string, batch_id bigint, loaded bigint, skipped bigint, late bigint"
LANDED = "landed"


def stateful_scores(rows: DataFrame, model: DataFrame, cols: list[str], z_limit: float = 3.0, delay: str = "1 day") -> DataFrame:
    """Scores of the intervals that a batch of the streaming ``rows(interval_ts, *cols)`` has changed."""
    counted = (rows.withColumn("__t", F.col("interval_ts").cast("timestamp")).withWatermark("__t", delay)
               .select("__t", *cols).unpivot(["__t"], cols, "metric_col", "metric_val")
               .filter(F.col("metric_val").isNotNull())
               .groupBy("__t", metric_key("metric_col", "metric_val").alias("metric_key")).agg(F.count(F.lit(1)).alias("current_count")))
    z = (F.col("current_count") - F.col("mean")) / F.col("std_dev")
    return (counted.join(model.select("metric_key", "mean", "std_dev").filter(F.col("std_dev") > 0), "metric_key")
            .select(F.col("__t").cast("timestamp_ntz").alias("interval_ts"), "metric_key", "current_count", "mean", "std_dev",
                    z.alias("z_score"), (F.abs(z) > F.lit(float(z_limit))).alias("is_alert")))


def start_stateful_alerts(spark: SparkSession, landing: str, model: DataFrame, out: str, checkpoint: str, cols: list[str],
                          z_limit: float = 3.0, delay: str = "1 day", available_now: bool = True, name: str | None = None,
                          **source_opts) -> StreamingQuery:
    """Score landed interval files into ``out``; read the alerts with :func:`current_alerts`."""
    landed = landed_interval_files(spark, landing, **source_opts)
    clean = valid_events(landed.observe(LANDED, F.count(F.lit(1)).alias("rows")), text_cols=cols)
    scores = stateful_scores(clean.observe("valid", F.count(F.lit(1)).alias("rows")), model, cols, z_limit, delay)

    def keep(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out))

    w = scores.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep)
    w = w.queryName(name) if name else w
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def current_alerts(spark: SparkSession, out: str) -> DataFrame:
    """Of each (type, interval) the newest score, where it is an alert."""
    scored = spark.read.schema(SCORE_SCHEMA).parquet(out)
    newest = scored.groupBy("interval_ts", "metric_key").agg(
        F.max_by(F.struct("current_count", "mean", "std_dev", "z_score", "is_alert"), "batch_id").alias("s"))
    return (newest.filter(F.col("s.is_alert"))
            .select("interval_ts", "metric_key", "s.current_count", "s.mean", "s.std_dev", "s.z_score"))


class StreamCounters(StreamingQueryListener):
    """Writes a counter row per batch of the listened queries: rows loaded, rows skipped as invalid, and rows too late
    for their window (counted behind the map-side combine). Register with ``spark.streams.addListener``."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if LANDED not in p.observedMetrics or not p.numInputRows:
            return
        loaded, valid = (p.observedMetrics[k]["rows"] for k in (LANDED, "valid"))
        late = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        row = (p.name or str(p.id), p.batchId, loaded, loaded - valid, late)
        (self._spark.createDataFrame([row], COUNTER_SCHEMA).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("query", "batch_id").parquet(self._path))


def wait_for_listeners(spark: SparkSession) -> None:
    """Until the progress of batches that have ended has reached the listeners."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COUNTER_SCHEMA).parquet(path)
