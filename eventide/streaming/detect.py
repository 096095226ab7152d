"""Streaming interval scoring against a static model.

Two forms:

* :func:`start_interval_alerts` — landed interval files. An interval may come in several
  files and so in several micro-batches: each batch appends its partial counts under its
  batch id, and the intervals it touched are scored from the sum of all partial counts so
  far. The latest score of an interval counts. A replayed batch replaces its own counts and
  scores. The model is read inside each batch, so the next one picks up a rebuilt model.
* :func:`windowed_counts` — row-time events: a watermark of one interval and tumbling
  windows; closed windows are emitted once (append mode) and rows later than the
  watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventide.operators.baseline import interval_counts
from eventide.operators.detect import score_counts
from eventide.operators.events import valid_events
from eventide.streaming.ingest import landed_interval_files


ALERT_SCHEMA = ("interval_ts timestamp_ntz, metric_key string, current_count bigint, mean double, "
                "std_dev double, z_score double, batch_id bigint")


COUNT_SCHEMA = "interval_ts timestamp_ntz, metric_key string, n bigint, interval_date date, batch_id bigint"


def read_alerts(spark: SparkSession, out: str) -> DataFrame:
    """The alerts of :func:`start_interval_alerts` (explicit schemas: a run without alerts leaves no
    data file to infer from): of each interval those of the last batch that had rows of it."""
    last = (spark.read.schema(COUNT_SCHEMA).parquet(f"{out}/counts").groupBy("interval_ts")
            .agg(F.max("batch_id").alias("batch_id")))
    return spark.read.schema(ALERT_SCHEMA).parquet(f"{out}/alerts").join(last, ["interval_ts", "batch_id"]).drop("batch_id")


def _by_batch(df: DataFrame, batch_id: int, path: str, *parts: str) -> None:
    (df.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*parts, "batch_id").parquet(path))


def score_batch(spark: SparkSession, batch: DataFrame, batch_id: int, model: DataFrame, out: str, cols: list[str],
                z_limit: float) -> None:
    """Add the batch's partial counts and write the scores of the intervals it touched."""
    clean = valid_events(batch, text_cols=cols)
    counts = interval_counts(clean, cols, "interval_ts").select("metric_key", "interval_ts", "n")
    _by_batch(counts.withColumn("interval_date", F.to_date("interval_ts")), batch_id, f"{out}/counts", "interval_date")
    stored = spark.read.schema(COUNT_SCHEMA).parquet(f"{out}/counts").filter(F.col("batch_id") <= batch_id)
    touched = stored.filter(F.col("batch_id") == batch_id).select("interval_date", "interval_ts").distinct()
    # the join on the partition column prunes the scan of earlier counts to the dates touched
    so_far = (stored.join(touched, ["interval_date", "interval_ts"], "left_semi")
              .groupBy("metric_key", "interval_ts").agg(F.sum("n").alias("n")))
    alerts = score_counts(so_far, model, z_limit).select(
        "interval_ts", "metric_key", F.col("n").alias("current_count"), "mean", "std_dev", "z_score")
    _by_batch(alerts, batch_id, f"{out}/alerts")


def start_interval_alerts(spark: SparkSession, landing: str, load_model: Callable[[], DataFrame],
                          out: str, checkpoint: str, cols: list[str], z_limit: float = 3.0,
                          available_now: bool = True, **source_opts) -> StreamingQuery:
    """Alerts for landed interval files under ``out``; read them with :func:`read_alerts`."""
    stream = landed_interval_files(spark, landing, **source_opts)

    def run(batch: DataFrame, batch_id: int) -> None:
        score_batch(batch.sparkSession, batch, batch_id, load_model(), out, cols, z_limit)

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def windowed_counts(stream: DataFrame, ts_col: str, cols: list[str], delay: str = "15 minutes",
                    step: str = "15 minutes") -> DataFrame:
    """Counts per type and tumbling window on row time. ``withWatermark`` needs a
    ``timestamp`` column, so ``timestamp_ntz`` input is cast first (G1)."""
    ts = F.col(ts_col).cast("timestamp")
    long = (stream.withColumn("__t", ts).withWatermark("__t", delay)
            .select("__t", *cols).unpivot(["__t"], cols, "metric_col", "metric_val")
            .filter(F.col("metric_val").isNotNull()))
    return (long.groupBy(F.window("__t", step).alias("w"), "metric_col", "metric_val")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("interval_start"),
                    F.concat_ws("_", "metric_col", "metric_val").alias("metric_key"), "n"))
