"""Scoring by streaming state: restatement, late rows, resumption and counters."""

import os

from pyspark.sql import functions as F

from eventide.plans.views import EVENT_COLUMNS
from eventide.streaming import stateful as SF

HEADER = ",".join(["interval_timestamp", *EVENT_COLUMNS])
COLS = ["event_root_code", "quad_class"]


def land(folder, name, rows):
    """``rows``: (stamp, root code, times)."""
    os.makedirs(folder, exist_ok=True)
    at = {c: i for i, c in enumerate(EVENT_COLUMNS)}
    lines = [HEADER]
    for stamp, code, times in rows:
        fields = [""] * len(EVENT_COLUMNS)
        fields[at["event_root_code"]] = code
        lines += [",".join([stamp, *fields])] * times
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join(lines) + "\n")


def start(spark, tmp, model, **opts):
    return SF.start_stateful_alerts(spark, f"{tmp}/in", model, f"{tmp}/out", f"{tmp}/ckpt", COLS, 3.0, max_files=1, **opts)


def alerts(spark, tmp):
    return {(f"{r.interval_ts:%d %H:%M}", r.metric_key): (r.current_count, r.z_score) for r in SF.current_alerts(spark, f"{tmp}/out").collect()}


def test_scores_are_restated_and_taken_back(spark, tmp):
    model = spark.createDataFrame([("event_root_code_01", 10.0, 2.0), ("event_root_code_02", 1.0, 0.0)], "metric_key string, mean double, std_dev double")
    t0, t1 = "2024-01-01T00:00:00+00:00", "2024-01-01T00:15:00+00:00"
    counters = f"{tmp}/counters"
    listener = SF.StreamCounters(spark, counters)
    spark.streams.addListener(listener)
    try:
        land(f"{tmp}/in", "1.csv", [(t0, "01", 2), (t0, "", 3), (t0, "02", 9)])
        start(spark, tmp, model, name="scoring").awaitTermination()
        assert alerts(spark, tmp) == {("01 00:00", "event_root_code_01"): (2, -4.0)}  # too few so far; no score without spread
        land(f"{tmp}/in", "2.csv", [(t0, "01", 7), (t1, "01", 20)])
        start(spark, tmp, model, name="scoring").awaitTermination()  # a restart: the state comes from the checkpoint
        assert alerts(spark, tmp) == {("01 00:15", "event_root_code_01"): (20, 5.0)}  # nine are usual: the first alert is taken back
        land(f"{tmp}/in", "3.csv", [("2024-01-09T00:00:00+00:00", "01", 10)])
        start(spark, tmp, model, name="scoring").awaitTermination()
        land(f"{tmp}/in", "4.csv", [(t0, "01", 50), ("2024-01-08T23:45:00+00:00", "01", 50)])
        start(spark, tmp, model, name="scoring").awaitTermination()
        SF.wait_for_listeners(spark)
    finally:
        spark.streams.removeListener(listener)
    got = alerts(spark, tmp)
    assert got[("08 23:45", "event_root_code_01")] == (50, 20.0) and ("01 00:00", "event_root_code_01") not in got  # behind the watermark
    rows = SF.read_counters(spark, counters).filter(F.col("query") == "scoring").orderBy("batch_id").collect()
    assert [(r.loaded, r.skipped) for r in rows] == [(14, 3), (27, 0), (10, 0), (100, 0)]
    assert [r.late for r in rows[:3]] == [0, 0, 0] and rows[3].late > 0


def test_no_stored_counts_are_read_again(spark, tmp):
    """The batch's plan holds state operators and no scan but the landed files and the model."""
    model = spark.createDataFrame([("event_root_code_01", 10.0, 2.0)], "metric_key string, mean double, std_dev double")
    stream = spark.readStream.format("rate").load().select(F.col("timestamp").cast("timestamp_ntz").alias("interval_ts"), F.lit("01").alias(COLS[0]),
                                                            F.lit("1").alias(COLS[1]))
    scores = SF.stateful_scores(stream, model, COLS)
    assert scores.isStreaming and scores.columns[-1] == "is_alert"
