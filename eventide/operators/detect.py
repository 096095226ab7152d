"""Per-interval two-sided z-score detection against a baseline model."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.numeric import fmt2
from eventide.functions.timefmt import STEP, ntz
from eventide.operators.baseline import interval_counts


def score_counts(counts: DataFrame, model: DataFrame, z_limit: float = 3.0) -> DataFrame:
    """Join current counts with the model by key, keep ``std_dev > 0`` and ``|z| > z_limit``.

    The model holds one row per type key, so the optimizer broadcasts it when its
    estimated size is under the broadcast threshold and falls back to a shuffle join
    otherwise; no hint forces it.
    """
    m = model.select("metric_key", "mean", "std_dev")
    return (counts.join(m, "metric_key")
            .filter(F.col("std_dev") > 0)
            .withColumn("z_score", (F.col("n") - F.col("mean")) / F.col("std_dev"))
            .filter(F.abs(F.col("z_score")) > F.lit(float(z_limit))))


def interval_anomalies(events: DataFrame, model: DataFrame, start: datetime, end: datetime,
                       cols: list[str], z_limit: float = 3.0, ts_col: str = "interval_ts",
                       score_missing: bool = False, step: str = STEP, source_ts: str | None = None) -> DataFrame:
    """Alerts for every interval in ``[start, end)`` and every type column in one pass.

    ``source_ts`` names the stored timestamp from which the interval is computed: the range is
    then also put on that column, where it reaches the scan.

    ``score_missing`` (off by default, as in the reference) also scores types absent from
    an interval as a count of 0, so drops to zero can alert (Q10).
    """
    ts = F.col(ts_col)
    current = events.filter((ts >= ntz(start)) & (ts < ntz(end)))
    if source_ts:
        raw = F.col(source_ts)
        current = current.filter((raw >= ntz(start)) & (raw < ntz(end) + F.expr(f"INTERVAL {step}")))
    counts = interval_counts(current, cols, ts_col).select("metric_key", ts_col, "n")
    if score_missing:
        keys = model.select("metric_key", F.explode(F.sequence(ntz(start), ntz(end), F.expr(f"INTERVAL {step}")))
                            .alias(ts_col)).filter(F.col(ts_col) < ntz(end))
        counts = (keys.join(counts, ["metric_key", ts_col], "left")
                  .select("metric_key", ts_col, F.coalesce(F.col("n"), F.lit(0)).alias("n")))
    return score_counts(counts, model, z_limit).select(
        ts_col, "metric_key", F.col("n").alias("current_count"), "mean", "std_dev", "z_score")


# The wording of the alert texts here and in eventide.operators.conflict.
def alert_messages(alerts: DataFrame) -> DataFrame:
    """Alert text in the reference's wording."""
    return alerts.withColumn("message", F.concat(
        F.lit("ALERT: Anomaly in '"), F.col("metric_key"), F.lit("' (Z-Score: "), fmt2(F.col("z_score")),
        F.lit("). Current: "), F.col("current_count").cast("string"), F.lit(", Baseline Mean: "),
        fmt2(F.col("mean"))))
