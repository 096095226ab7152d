"""Structured Streaming twins checked against their batch results."""

import os

from pyspark.sql import functions as F

from eventide.functions.timefmt import day_start, ntz

from eventide.operators import baseline as B
from eventide.operators import detect as D
from eventide.operators import graph as G
from eventide.operators.events import accepted_rows, valid_events
from eventide.plans import params as P
from eventide.plans.catalog import clean_interactions, interval_events
from eventide.plans.views import EVENT_COLUMNS, table
from eventide.streaming import ingest as I
from eventide.streaming.detect import read_alerts, score_batch, start_interval_alerts, windowed_counts
from eventide.streaming.stats import running_stats_stream

SF = "/root/testdata/sf0.001"


def land(pdf, landing, key_col):
    """One headed CSV per interval, named by its stamp (as the interval producer does)."""
    os.makedirs(landing, exist_ok=True)
    for key, g in pdf.groupby(key_col):
        g.drop(columns=[key_col]).to_csv(f"{landing}/{key}.csv", index=False)


def interval_pdf(spark):
    clean = clean_interactions(spark, SF).withColumn("interval_ts", day_start("sqldate"))
    return (clean.select(F.concat(F.date_format("interval_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
                         .alias("interval_timestamp"), *EVENT_COLUMNS,
                         F.date_format("interval_ts", "yyyyMMddHHmmss").alias("key"))
            .toPandas())


def test_file_stream_ingest_equals_batch_and_resumes(spark, tmp):
    pdf = interval_pdf(spark)
    keys = sorted(pdf.key.unique())
    waves = [keys[: len(keys) // 3], keys[len(keys) // 3: 2 * len(keys) // 3], keys[2 * len(keys) // 3:]]
    landing, root, ckpt = f"{tmp}/landing", f"{tmp}/graph", f"{tmp}/ckpt"
    for wave in waves[:2]:
        land(pdf[pdf.key.isin(wave)], landing, "key")
        I.start_graph_ingest(spark, landing, root, ckpt).awaitTermination()
    before = I.read_graph(spark, root)["interactions"].count()
    # restart with the same checkpoint and nothing new: no batch, no duplicates
    I.start_graph_ingest(spark, landing, root, ckpt).awaitTermination()
    assert I.read_graph(spark, root)["interactions"].count() == before
    land(pdf[pdf.key.isin(waves[2])], landing, "key")
    I.start_graph_ingest(spark, landing, root, ckpt).awaitTermination()

    g = I.read_graph(spark, root)
    batch_rows = accepted_rows(clean_interactions(spark, SF))
    want = sorted(map(tuple, G.interaction_edges(batch_rows).collect()), key=str)
    got = sorted(map(tuple, g["interactions"].drop("event_id").collect()), key=str)
    assert got == want
    n = batch_rows.count()
    assert g["event_nodes"].count() == n and g["impacts"].count() == 2 * n
    assert g["event_nodes"].select("event_id").distinct().count() == n
    # last write wins in file (interval) order, actor1 before actor2
    pos = pdf.reset_index(drop=True).reset_index()
    order = spark.createDataFrame(pos[["index", "key"] + EVENT_COLUMNS].astype({"index": "int64"}))
    ordered = accepted_rows(valid_events(order, text_cols=EVENT_COLUMNS)).withColumn(
        "o", F.struct("key", "index"))
    want_actors = {r.name: r.code for r in G.actor_nodes(ordered, "o").collect()}
    assert {r.name: r.code for r in g["actors"].collect()} == want_actors


def test_interval_alert_stream_equals_batch(spark, tmp):
    sf = "/root/testdata/sf0.01"
    ev = interval_events(spark, sf)
    counts = B.interval_counts(ev, P.METRIC_COLUMNS)
    model = B.baseline_sparse(counts, B.significant_types(counts, P.MIN_TOTAL), P.BASELINE_START, P.BASELINE_END)
    model_path = f"{tmp}/model"
    model.write.parquet(model_path)
    det = ev.filter((F.col("interval_ts") >= ntz(P.DETECT_START)) & (F.col("interval_ts") < ntz(P.DETECT_END)))
    pdf = (det.select(F.concat(F.date_format("interval_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
                      .alias("interval_timestamp"),
                      *[F.lit(None).cast("string").alias(c) if c not in P.METRIC_COLUMNS else F.col(c)
                        for c in EVENT_COLUMNS],
                      F.date_format("interval_ts", "yyyyMMddHHmmss").alias("key")).toPandas())
    land(pdf, f"{tmp}/landing", "key")
    q = start_interval_alerts(spark, f"{tmp}/landing", lambda: spark.read.parquet(model_path),
                              f"{tmp}/alerts", f"{tmp}/ckpt", P.METRIC_COLUMNS, P.Z_LIMIT, max_files=200)
    q.awaitTermination()
    got = read_alerts(spark, f"{tmp}/alerts")
    want = D.interval_anomalies(ev, model, P.DETECT_START, P.DETECT_END, P.METRIC_COLUMNS, P.Z_LIMIT)
    r = lambda df: sorted((x.interval_ts, x.metric_key, x.current_count, round(x.z_score, 9)) for x in df.collect())
    assert r(got) == r(want) and len(r(want)) > 0


def test_running_stats_stream_equals_batch(spark, tmp):
    ev = table(spark, SF, "events").select("event_type", "value", "ts")
    for i, (lo, hi) in enumerate([("2024-01-01", "2024-01-08"), ("2024-01-08", "2024-01-16"),
                                  ("2024-01-16", "2024-02-01")]):
        ev.filter((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.parquet(f"{tmp}/in/p{i}")
        os.rename(next(f"{tmp}/in/p{i}/{f}" for f in os.listdir(f"{tmp}/in/p{i}") if f.endswith(".parquet")),
                  f"{tmp}/in/part{i}.parquet")
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
              .option("pathGlobFilter", "part*.parquet").parquet(f"{tmp}/in"))
    q = (running_stats_stream(stream, "event_type", "value").writeStream.outputMode("update")
         .format("memory").queryName("rs_out").option("checkpointLocation", f"{tmp}/ck").start())
    q.processAllAvailable()
    q.stop()
    out = spark.sql("SELECT * FROM rs_out")
    rows = out.collect()
    last = {r.event_type: r for r in rows}
    for r in rows:
        if r.n > last[r.event_type].n:
            last[r.event_type] = r
    want = {r.event_type: r for r in B.running_stats(ev, "event_type", "value").collect()}
    assert last.keys() == want.keys()
    for k in want:
        assert last[k].n == want[k].n
        assert abs(last[k].mean - want[k].mean) < 1e-9 and abs(last[k].std_dev - want[k].std_dev) < 1e-9


def test_late_row_dropped_by_watermark(spark, tmp):
    rows1 = [(f"2024-01-01 00:{m:02d}:00", "A") for m in (1, 2, 20, 40, 59)]
    # Late rows are judged against the previous batch's watermark, so the late 00:05 row
    # comes two batches after the rows that moved the watermark past 00:15.
    rows2 = [("2024-01-01 02:00:00", "A")]
    rows3 = [("2024-01-01 00:05:00", "A"), ("2024-01-01 04:00:00", "A")]
    for i, rws in enumerate([rows1, rows2, rows3]):
        (spark.createDataFrame(rws, "t string, event_root_code string")
         .select(F.to_timestamp_ntz("t").alias("ts"), "event_root_code")
         .coalesce(1).write.parquet(f"{tmp}/w/b{i}"))
    schema = "ts timestamp_ntz, event_root_code string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", True).parquet(f"{tmp}/w")
    q = (windowed_counts(stream, "ts", ["event_root_code"]).writeStream.outputMode("append")
         .format("memory").queryName("late_out").option("checkpointLocation", f"{tmp}/ck2").start())
    q.processAllAvailable()
    q.stop()
    got = {str(r.interval_start)[11:16]: r.n for r in spark.sql("SELECT * FROM late_out").collect()}
    assert got["00:00"] == 2  # the late 00:05 row arrived after the watermark passed 00:15
    assert got["00:15"] == 1 and got["00:30"] == 1 and got["00:45"] == 1


def test_replayed_batch_changes_nothing(spark, tmp):
    """A micro-batch re-run after a failure (same batch id) overwrites its own output."""
    pdf = interval_pdf(spark)
    land(pdf[pdf.key.isin(sorted(pdf.key.unique())[:20])], f"{tmp}/landing", "key")
    batch = spark.read.schema(I.LANDED_SCHEMA).option("header", True).csv(f"{tmp}/landing") \
        .withColumn("interval_ts", F.lit(None).cast("timestamp_ntz")) \
        .withColumn("source_file", F.col("_metadata.file_name")) \
        .withColumn("block_start", F.col("_metadata.file_block_start"))
    root = f"{tmp}/graph"
    I.apply_batch(spark, root, batch, 0)
    first = {k: sorted(map(tuple, v.drop("event_id").collect()), key=str) for k, v in I.read_graph(spark, root).items()}
    I.apply_batch(spark, root, batch, 0)  # replay of batch 0
    again = {k: sorted(map(tuple, v.drop("event_id").collect()), key=str) for k, v in I.read_graph(spark, root).items()}
    assert first == again and len(first["interactions"]) > 0


def test_actor_compaction_keeps_the_answer(spark, tmp):
    pdf = interval_pdf(spark)
    keys = sorted(pdf.key.unique())
    landing = f"{tmp}/landing"
    answers = []
    for every, root in ((None, f"{tmp}/g1"), (1, f"{tmp}/g2"), (2, f"{tmp}/g3")):
        lz = f"{landing}-{every}"
        for i, wave in enumerate([keys[:15], keys[15:30], keys[30:45]]):
            land(pdf[pdf.key.isin(wave)], lz, "key")
            I.start_graph_ingest(spark, lz, root, f"{root}-ckpt", compact_every=every).awaitTermination()
        answers.append(sorted(map(tuple, I.read_graph(spark, root)["actors"].collect()), key=str))
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) > 0


def test_split_interval_and_replayed_batch_score_once(spark, tmp):
    """An interval in two batches is scored on its sum, and a replay changes nothing."""
    model = spark.createDataFrame([("event_root_code_04", 1.0, 1.0, 10)],
                                  "metric_key string, mean double, std_dev double, total_occurrences long")
    batch = (spark.range(3).select(F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("interval_ts"),
                                   F.lit("04").alias("event_root_code")))
    out = f"{tmp}/alerts"
    score_batch(spark, batch, 0, model, out, ["event_root_code"], 3.0)
    assert read_alerts(spark, out).count() == 0  # three rows: z is 2
    for _ in range(2):
        score_batch(spark, batch, 1, model, out, ["event_root_code"], 3.0)
        assert [(r.current_count, r.z_score) for r in read_alerts(spark, out).collect()] == [(6, 5.0)]


def test_reset_after_ingest_and_half_written_snapshot(spark, tmp):
    pdf = interval_pdf(spark)
    keys = sorted(pdf.key.unique())[:20]
    root, ckpt = f"{tmp}/graph", f"{tmp}/ckpt"
    land(pdf[pdf.key.isin(keys)], f"{tmp}/landing", "key")
    I.start_graph_ingest(spark, f"{tmp}/landing", root, ckpt, compact_every=1).awaitTermination()
    before = sorted(map(tuple, I.read_graph(spark, root)["actors"].collect()), key=str)
    os.makedirs(f"{root}/actors/v=99")  # a crash while a later snapshot was being written
    assert sorted(map(tuple, I.read_graph(spark, root)["actors"].collect()), key=str) == before and before
    G.reset_graph(spark, root)
    assert all(t.count() == 0 for t in I.read_graph(spark, root).values())
    I.start_graph_ingest(spark, f"{tmp}/landing", root, f"{tmp}/ckpt2").awaitTermination()
    assert sorted(map(tuple, I.read_graph(spark, root)["actors"].collect()), key=str) == before
    assert I.read_graph(spark, root)["interactions"].count() > 0
