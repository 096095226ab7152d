"""Golden micro-fixtures for the quirks listed in FIXTURES.md (section D)."""

import io
import re
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eventide.functions.text import whole_word_pattern
from eventide.operators import baseline as B
from eventide.operators import conflict as C
from eventide.operators import detect as D
from eventide.operators import graph as G
from eventide.operators import triples as T
from eventide.operators.events import accepted_rows, stamp_intervals, valid_events
from eventide.plans.views import EVENT_COLUMNS
from eventide.sources import export as EX
from eventide.sources import model_state as MS

ROW = dict(sqldate="20240101", actor1_code="A1", actor1_name="ALPHA", actor2_code="B1", actor2_name="BETA",
           event_code="043", event_base_code="043", event_root_code="04", quad_class="1",
           goldstein_scale="-2", num_mentions="1", avg_tone="0")
SCHEMA = ", ".join(f"{c} string" for c in EVENT_COLUMNS)


def rows(spark, *overrides):
    data = [tuple({**ROW, **o}[c] for c in EVENT_COLUMNS) for o in overrides]
    return spark.createDataFrame(data, SCHEMA)


def test_leading_zero_kept(spark):
    df = valid_events(rows(spark, {})).withColumn("interval_ts", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"))
    keys = {r.metric_key for r in B.interval_counts(df, ["event_root_code"]).collect()}
    assert keys == {"event_root_code_04"}


def test_na_tokens_and_empty_root(spark):
    df = rows(spark, {"actor1_name": "NULL"}, {"actor1_name": "NA"}, {"actor1_name": "n/a"},
              {"event_root_code": ""}, {"event_root_code": None})
    out = valid_events(df, text_cols=EVENT_COLUMNS).collect()
    assert len(out) == 3 and all(r.actor1_name is None for r in out)


def test_missing_actor_or_code_makes_nothing(spark):
    df = rows(spark, {"actor1_name": None}, {"actor2_name": ""}, {"event_code": ""}, {})
    acc = accepted_rows(df)
    assert acc.count() == 1
    assert G.interaction_edges(df).count() == 1


def test_bad_and_zero_goldstein_not_conflict(spark):
    df = rows(spark, {"goldstein_scale": "abc"}, {"goldstein_scale": ""}, {"goldstein_scale": "0"},
              {"goldstein_scale": "0.0"}, {"goldstein_scale": "NaN"}, {"goldstein_scale": "-0.5"})
    assert C.conflict_edges(G.interaction_edges(df)).count() == 1


def test_self_loop_one_actor_three_edges(spark):
    df = rows(spark, {"actor2_name": "ALPHA", "actor2_code": "A2"}).withColumn("event_id", F.lit("e1"))
    acc = accepted_rows(df)
    actors = G.actor_nodes(acc.withColumn("o", F.lit(1)), "o").collect()
    assert len(actors) == 1 and actors[0].code == "A2"  # actor2 side is written last
    assert G.interaction_edges(df).count() + G.impact_edges(df).count() == 3


def test_null_last_code_overwrites(spark):
    df = rows(spark, {"actor1_code": "X"}, {"actor1_code": None}).withColumn(
        "o", F.monotonically_increasing_id())
    got = {r.name: r.code for r in G.actor_nodes(df, "o").collect()}
    assert got["ALPHA"] is None


def test_upsert_sequence_equals_union(spark):
    a = rows(spark, {"actor1_code": "X"}, {"actor1_name": "GAMMA", "actor1_code": "G"}).withColumn("o", F.lit(1))
    b = rows(spark, {"actor1_code": None}).withColumn("o", F.lit(2))
    empty = G.empty_graph(spark)["actors"]
    seq = G.merge_actor_batch(G.merge_actor_batch(empty, a, "o"), b, "o")
    once = G.merge_actor_batch(empty, a.unionByName(b), "o")
    assert sorted(map(tuple, seq.collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    again = G.merge_actor_batch(seq, b, "o")  # the same batch twice changes nothing
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, seq.collect()), key=str)


def test_one_day_pair_std_floor_and_no_recent(spark):
    e = G.interaction_edges(rows(spark, {"sqldate": "20240101"}, {"sqldate": "20240101"}))
    out = C.conflict_anomaly(e, as_of="20240110", days=1).collect()[0]
    assert out.std_dev == 1.0 and out.mean == 2.0 and out.recent_count == 0
    assert out.z_score == -2.0 and out.is_anomaly is False


def test_null_date_group_never_recent_sorted_first(spark):
    df = rows(spark, {"sqldate": None}, {"sqldate": "20240105"}, {"sqldate": "20240106"})
    e = G.interaction_edges(df)
    daily = C.daily_conflict_counts(C.conflict_edges(e))
    assert daily.filter(F.col("date").isNull()).count() == 1
    out = C.conflict_anomaly(e, as_of="20240106", days=30).collect()[0]
    assert out.days_with_events == 3 and out.recent_count == 2
    first = G.recent_interactions(e, "ALPHA", 15).collect()[0]
    assert first.date is None


def test_threshold_strict_and_constant_series(spark):
    # totals: type A = 3 (at threshold 3: not significant), type B = 4
    ts = ["2024-01-01 00:00:00", "2024-01-01 00:15:00", "2024-01-01 00:30:00"]
    data = [(t, "A") for t in ts] + [(t, "B") for t in ts] + [("2024-01-01 00:30:00", "B")]
    df = spark.createDataFrame(data, "t string, event_root_code string").select(
        F.to_timestamp_ntz("t").alias("interval_ts"), "event_root_code")
    counts = B.interval_counts(df, ["event_root_code"])
    sig = {r.metric_key for r in B.significant_types(counts, 3).collect()}
    assert sig == {"event_root_code_B"}
    # constant series: std 0, never scored
    model = spark.createDataFrame([("event_root_code_A", 1.0, 0.0, 3)], "metric_key string, mean double, "
                                  "std_dev double, total_occurrences long")
    alerts = D.interval_anomalies(df, model, datetime(2024, 1, 1), datetime(2024, 1, 2), ["event_root_code"], 0.0)
    assert alerts.count() == 0


def test_z_exactly_at_limit_is_not_alert(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "A")] * 4, "t string, event_root_code string").select(
        F.to_timestamp_ntz("t").alias("interval_ts"), "event_root_code")
    model = spark.createDataFrame([("event_root_code_A", 1.0, 1.0, 3)], "metric_key string, mean double, "
                                  "std_dev double, total_occurrences long")
    assert D.interval_anomalies(df, model, datetime(2024, 1, 1), datetime(2024, 1, 2),
                                ["event_root_code"], 3.0).count() == 0
    assert D.interval_anomalies(df, model, datetime(2024, 1, 1), datetime(2024, 1, 2),
                                ["event_root_code"], 2.99).count() == 1


def test_out_of_range_row_counts_to_threshold_not_total(spark):
    data = [("2024-01-01 00:00:00", "A"), ("2024-01-01 00:15:00", "A"), ("2024-02-01 00:00:00", "A")]
    df = spark.createDataFrame(data, "t string, event_root_code string").select(
        F.to_timestamp_ntz("t").alias("interval_ts"), "event_root_code")
    counts = B.interval_counts(df, ["event_root_code"])
    sig = B.significant_types(counts, 2)
    assert sig.count() == 1
    m = B.baseline_sparse(counts, sig, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 45)).collect()[0]
    assert m.total_occurrences == 2 and m.mean == 0.5
    d = B.baseline_dense(counts, sig, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 45)).collect()[0]
    assert d.total_occurrences == 2 and abs(d.std_dev - m.std_dev) < 1e-12


def test_country_without_capital_dropped_by_default(spark):
    t = spark.createDataFrame([
        ("c/1", "type", "Country", None), ("c/1", "label", "One", "en"), ("c/1", "capital", "k/1", None),
        ("k/1", "label", "Cap", "en"),
        ("c/2", "type", "Country", None), ("c/2", "label", "Two", "en"), ("c/2", "isoCode", "T", None),
    ], "s string, p string, o string, lang string")
    assert {r.name for r in T.country_bindings(t).collect()} == {"One"}
    assert {r.name for r in T.country_bindings(t, capital_optional=True).collect()} == {"One", "Two"}


@pytest.mark.parametrize("term,text,expected", [
    ("C++", "we use C++ daily", False),   # '\b' after '+' needs a word char next
    ("C++", "C++x", True),
    ("a.b", "axb", False),
    ("a.b", "see a.b here", True),
    ("the", "THE end", True),
    ("the", "other", False),
    ("élan", "Élan vital", True),
    ("und", "Grund und Boden", True),
])
def test_whole_word_literal_match(spark, term, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(whole_word_pattern(term))).head()[0]
    assert got is expected
    assert bool(re.search(r"\b" + re.escape(term) + r"\b", text, re.IGNORECASE)) is expected


def test_model_state_validation(spark, tmp):
    with pytest.raises(FileNotFoundError):
        MS.read_model_state(spark, f"{tmp}/missing")
    spark.createDataFrame([('{"other": 1}',)], "value string").write.text(f"{tmp}/bad")
    with pytest.raises(ValueError):
        MS.read_model_state(spark, f"{tmp}/bad")
    model = spark.createDataFrame([("event_root_code_04", 1.5, 0.5, 10)], "metric_key string, mean double, "
                                  "std_dev double, total_occurrences long")
    MS.write_model_state(model, f"{tmp}/good")
    assert MS.read_model_state(spark, f"{tmp}/good").collect()[0].total_occurrences == 10
    assert MS.model_json_lines(model).head()[0].startswith('{"event_metrics":{"event_root_code_04":')


def test_latin1_export_roundtrip(spark, tmp):
    df = rows(spark, {"actor1_name": "CÔTE D'IVOIRE"})
    EX.write_export_tsv(df, f"{tmp}/tsv")
    got = EX.read_export_tsv(spark, f"{tmp}/tsv").collect()
    assert got[0].actor1_name == "CÔTE D'IVOIRE" and got[0].event_root_code == "04"


def test_zip_scan_skips_corrupt_and_empty(spark, tmp):
    import os
    os.makedirs(f"{tmp}/z")
    line = "\t".join(["x"] * 61)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("20240101000000.export.CSV", (line + "\n" + "é\x85" + "\t" * 60 + "\n").encode("latin-1"))
    open(f"{tmp}/z/20240101000000.export.CSV.zip", "wb").write(buf.getvalue())
    EX.land_bad_archives(f"{tmp}/z")
    rep = {r.status: r.files for r in EX.zip_scan_report(spark, f"{tmp}/z").collect()}
    assert rep == {"ok": 1, "bad_zip": 2, "empty": 1}
    from pyspark.sql import Observation
    obs = Observation("zip_scan")
    got = EX.read_export_zips(spark, f"{tmp}/z", observation=obs).collect()
    assert obs.get == {"bad_archives": 2, "empty_archives": 1, "lines": 2}
    assert len(got) == 2
    odd = [r for r in got if r.source_event_id != "x"][0]
    assert odd.source_event_id == "é\x85" and odd.sqldate is None  # 0x85 is not a line break
    assert str(odd.interval_ts) == "2024-01-01 00:00:00"  # stamp from the file name


def test_graph_reset_and_referential_check(spark, tmp):
    df = rows(spark, {}, {"actor2_name": "GAMMA"}).withColumn("event_id", F.monotonically_increasing_id().cast("string"))
    acc = accepted_rows(df)
    assert G.dangling_edges(G.interaction_edges(acc), G.actor_nodes(acc.withColumn("o", F.lit(1)), "o")).count() == 0
    G.reset_graph(spark, f"{tmp}/g")
    for name in ("actors", "countries", "event_nodes", "interactions", "impacts"):
        t = spark.read.parquet(f"{tmp}/g/{name}")
        assert t.count() == 0 and t.schema == G.empty_graph(spark)[name].schema


def test_article_file_short_rows(spark, tmp):
    from eventide.sources.articles import read_article_file
    import os
    os.makedirs(f"{tmp}/a")
    full = "\t".join(f"v{i}" for i in range(30))
    short = "\t".join(f"w{i}" for i in range(20))
    open(f"{tmp}/a/x.csv", "w").write(full + "\n" + short + "\n")
    got = {r.record_id: r for r in read_article_file(spark, f"{tmp}/a").collect()}
    assert got["v0"].organizations == "v19" and got["v0"].extras == "v29"
    assert got["w0"].organizations == "w19" and got["w0"].persons is None and got["w0"].extras is None


def test_backfill_skips_present_days(spark, tmp):
    from eventide.sources.backfill import backfill_days
    src = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-04", 4)], "d string, v int") \
        .select(F.to_date("d").alias("day"), "v")
    first = backfill_days(spark, src.filter(F.col("v") == 1), f"{tmp}/t", "2024-01-01", "2024-01-05")
    assert [r.day for r in first.collect()] == ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05"]
    second = backfill_days(spark, src.withColumn("v", F.col("v") * 10), f"{tmp}/t", "2024-01-01", "2024-01-05")
    assert "2024-01-01" not in [r.day for r in second.collect()]
    got = {str(r.day): r.v for r in spark.read.parquet(f"{tmp}/t").collect()}
    assert got == {"2024-01-01": 1, "2024-01-02": 20, "2024-01-04": 40}  # day 1 kept, empty day 3 absent


def test_resume_marker(spark, tmp):
    from eventide.sources.interval_log import mark_processed, unprocessed
    log = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 00:15:00",), ("2024-01-01 00:30:00",)],
                                "t string").select(F.to_timestamp_ntz("t").alias("interval_ts"))
    assert unprocessed(spark, log, f"{tmp}/m").count() == 3
    mark_processed(spark, f"{tmp}/m", log.limit(2).orderBy("interval_ts"))
    assert unprocessed(spark, log, f"{tmp}/m").count() == 1


def test_iso_parse_offsets(spark):
    from eventide.sources.interval_log import parse_iso_utc
    df = spark.createDataFrame([("2024-01-01T00:15:00+00:00",), ("2024-01-01T02:15:00+02:00",),
                                ("2023-12-31T23:15:00-01:00",), ("2024-01-01T00:15:00Z",)], "s string")
    got = {str(r[0]) for r in df.select(parse_iso_utc("s")).collect()}
    assert got == {"2024-01-01 00:15:00"}


def test_alert_message_wording(spark):
    alerts = spark.createDataFrame([("event_root_code_04", 10, 2.0, 1.0, 8.0)],
                                   "metric_key string, current_count long, mean double, std_dev double, z_score double")
    msg = D.alert_messages(alerts).head().message
    assert msg == "ALERT: Anomaly in 'event_root_code_04' (Z-Score: 8.00). Current: 10, Baseline Mean: 2.00"


@pytest.mark.parametrize("bad", ["{broken", '{"other": 1}', ""])
def test_model_line_that_cannot_be_read_is_an_error(spark, tmp, bad):
    good = '{"event_metrics": {"quad_class_1": {"mean": 0.25, "std_dev": 0.5, "total_occurrences": 7}}}'
    spark.createDataFrame([(good,), (bad,)], "value string").write.text(f"{tmp}/model")
    with pytest.raises(Exception, match="event_metrics"):
        MS.read_model_state(spark, f"{tmp}/model").collect()


def test_sparse_model_equals_two_step(spark):
    ts = ["2024-01-01 00:00:00", "2024-01-01 00:15:00", "2024-01-01 00:30:00", "2024-01-02 00:00:00"]
    data = [(t, c) for t in ts for c in "AB"] + [(ts[0], "A")] * 3
    df = spark.createDataFrame(data, "t string, event_root_code string").select(
        F.to_timestamp_ntz("t").alias("interval_ts"), "event_root_code")
    counts = B.interval_counts(df, ["event_root_code"])
    a, b = datetime(2024, 1, 1), datetime(2024, 1, 1, 1, 0)
    fused = sorted(map(tuple, B.sparse_model(counts, 4, a, b).collect()))
    two = sorted(map(tuple, B.baseline_sparse(counts, B.significant_types(counts, 4), a, b).collect()))
    assert fused == two and len(fused) == 1


def test_graph_counts_from_rows_equals_tables(spark):
    df = rows(spark, {}, {"actor2_name": "GAMMA"}, {"actor1_name": "BETA", "actor2_name": "BETA"}) \
        .withColumn("event_id", F.monotonically_increasing_id().cast("string"))
    acc = accepted_rows(df)
    full = G.graph_counts(G.actor_nodes(acc.withColumn("o", F.lit(1)), "o"), G.event_nodes(acc),
                          G.interaction_edges(acc), G.impact_edges(acc)).head()
    fast = G.graph_counts_from_rows(acc).head()
    assert tuple(full) == tuple(fast) == (3 + 3, 9)


def test_exclude_recent_option(spark):
    df = rows(spark, {"sqldate": "20240101"}, {"sqldate": "20240102"}, {"sqldate": "20240110"},
              {"sqldate": "20240110"}, {"sqldate": "20240110"})
    e = G.interaction_edges(df)
    parity = C.conflict_anomaly(e, as_of="20240110", days=1).head()
    assert parity.days_with_events == 3 and parity.recent_count == 3
    held_out = C.conflict_anomaly(e, as_of="20240110", days=1, exclude_recent=True).head()
    assert held_out.days_with_events == 2 and held_out.mean == 1.0 and held_out.recent_count == 3
    assert held_out.z_score == 2.0  # (3 - 1) / max(0, 1)


def test_score_missing_scores_drops_to_zero(spark):
    t = ["2024-01-01 00:00:00", "2024-01-01 00:15:00"]
    df = spark.createDataFrame([(t[0], "A")] * 5, "t string, event_root_code string").select(
        F.to_timestamp_ntz("t").alias("interval_ts"), "event_root_code")
    model = spark.createDataFrame([("event_root_code_A", 5.0, 1.0, 100)], "metric_key string, mean double, "
                                  "std_dev double, total_occurrences long")
    a, b = datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 30)
    assert D.interval_anomalies(df, model, a, b, ["event_root_code"]).count() == 0
    got = D.interval_anomalies(df, model, a, b, ["event_root_code"], score_missing=True).collect()
    assert [(str(r.interval_ts), r.current_count, r.z_score) for r in got] == [("2024-01-01 00:15:00", 0, -5.0)]


def test_prices_file_per_ticker_layout(spark, tmp):
    from eventide.sources.prices import read_prices
    import os
    os.makedirs(f"{tmp}/p")
    hdr = "Date,Open,High,Low,Close,Adj Close,Volume\n"
    open(f"{tmp}/p/NVDA.csv", "w").write(hdr + "2024-01-02,1.0,2.0,0.5,1.5,1.5,100\n2024-01-03,1.5,2.5,1.0,2.0,2.0,200\n")
    open(f"{tmp}/p/AAPL.csv", "w").write(hdr + "2024-01-02,10.0,11.0,9.0,10.5,10.5,5\n")
    got = sorted((r.ticker, str(r.price_date), r.close, r.volume)
                 for r in read_prices(spark, f"{tmp}/p", layout="file_per_ticker").collect())
    assert got == [("AAPL", "2024-01-02", 10.5, 5), ("NVDA", "2024-01-02", 1.5, 100), ("NVDA", "2024-01-03", 2.0, 200)]


def test_interval_log_parquet_day_rerun_replaces_only_its_days(spark, tmp):
    from eventide.sources.interval_log import read_interval_log, write_interval_log
    base = rows(spark, {"sqldate": "20240101"}, {"sqldate": "20240102"}, {"sqldate": "20240102"})
    with_ts = base.withColumn("interval_ts", F.to_timestamp_ntz("sqldate", F.lit("yyyyMMdd")))
    write_interval_log(with_ts, f"{tmp}/log", fmt="parquet")
    rerun = with_ts.filter(F.col("sqldate") == "20240102").limit(1)  # day 2 reprocessed
    write_interval_log(rerun, f"{tmp}/log", fmt="parquet")
    got = read_interval_log(spark, f"{tmp}/log", fmt="parquet")
    assert sorted(r.sqldate for r in got.collect()) == ["20240101", "20240102"]
    assert {str(r.interval_ts) for r in got.collect()} == {"2024-01-01 00:00:00", "2024-01-02 00:00:00"}


def test_interval_log_csv_has_stamp_first(spark, tmp):
    import glob
    from eventide.sources.interval_log import write_interval_log
    df = rows(spark, {}).withColumn("interval_ts", F.to_timestamp_ntz(F.lit("2024-01-01 00:15:00")))
    write_interval_log(df, f"{tmp}/log")
    f = sorted(glob.glob(f"{tmp}/log/interval_date=2024-01-01/*.csv"))[0]
    header, first = open(f).read().splitlines()[:2]
    assert header.split(",")[:2] == ["interval_timestamp", "sqldate"]
    assert first.startswith("2024-01-01T00:15:00+00:00,20240101,")


def test_article_file_mentions_over_three_columns(spark, tmp):
    import os
    from eventide.operators import mentions as M
    from eventide.sources.articles import read_article_file
    os.makedirs(f"{tmp}/gkg")

    def line(rid, orgs="", pers="", locs="", extras=None, width=30):
        cells = [""] * width
        cells[0], cells[19], cells[21], cells[23] = rid, orgs, pers, locs
        if extras is not None:
            cells[29] = extras
        return "\t".join(cells if extras is not None else cells[:24])

    rows_ = [line("a1", orgs="United Nations;Apple", extras="<x>1</x>"),
             line("a2", pers="joe biden", extras=""),                 # empty extras -> default text
             line("a3", locs="Kyiv", extras="<x>3</x>"),
             line("a4", orgs="Pineapple Inc")]                         # short row, no extras column
    open(f"{tmp}/gkg/f.csv", "w").write("\n".join(rows_) + "\n")
    arts = read_article_file(spark, f"{tmp}/gkg")
    terms = ["Vladimir Putin", "Joe Biden", "Apple", "Kyiv"]
    found = M.mentions(arts, terms, ["organizations", "persons", "locations"], id_col="record_id",
                       keep=["extras"])
    counts = {r.entity: r.n_mentions for r in M.mention_counts(spark, found, terms).collect()}
    assert counts == {"Vladimir Putin": 0, "Joe Biden": 1, "Apple": 1, "Kyiv": 1}  # not "Pineapple"
    first = M.first_tracked_entity(found, 5, id_col="record_id", show_col="extras").collect()
    assert [(r.entity, r.n_mentions, r.record_id, r.content) for r in first] == \
        [("Joe Biden", 1, "a2", "(No XML content)")]


def test_null_stamps_and_timestamps_are_kept(spark, tmp):
    df = rows(spark, {}, {"actor1_name": "GAMMA"}).withColumn("stamp", F.when(F.col("actor1_name") != "GAMMA", F.lit("20240101000000")))
    landed = EX.write_export_zips(df, f"{tmp}/z", "stamp").collect()
    assert sum(r["rows"] for r in landed) == 2 and EX.read_export_zips(spark, f"{tmp}/z").count() == 2
    ts = spark.createDataFrame([("2024-01-01 00:14:59.5",), (None,)], "t string").select(F.to_timestamp_ntz("t").alias("ts"))
    got = {str(r.interval_ts) for r in stamp_intervals(ts, "ts").collect()}
    assert got == {"2024-01-01 00:00:00", "None"}


def test_quoted_fields_read_the_same_from_plain_and_zipped_files(spark, tmp):
    import os
    line = "\t".join(["id", "20240101"] + [f'"Q {i}"' for i in range(2, 61)])
    os.makedirs(f"{tmp}/z")
    with zipfile.ZipFile(f"{tmp}/z/20240101000000.export.CSV.zip", "w") as zf:
        zf.writestr("20240101000000.export.CSV", line + "\n")
    os.makedirs(f"{tmp}/p")
    open(f"{tmp}/p/20240101000000.export.CSV", "w").write(line + "\n")
    a = EX.read_export_zips(spark, f"{tmp}/z").select(*EX.NAMES).collect()
    b = EX.read_export_tsv(spark, f"{tmp}/p").select(*EX.NAMES).collect()
    assert a == b and a[0].actor1_name == "Q 6"


def test_export_writer_refuses_what_its_encoding_lacks(spark, tmp):
    with pytest.raises(Exception, match="actor1_name"):
        EX.write_export_tsv(rows(spark, {"actor1_name": "\u20ac"}), f"{tmp}/t")


def test_resume_marker_survives_an_empty_run(spark, tmp):
    from eventide.sources.interval_log import mark_processed, unprocessed
    log = spark.createDataFrame([("2024-01-01 00:00:00",)], "t string").select(F.to_timestamp_ntz("t").alias("interval_ts"))
    mark_processed(spark, f"{tmp}/m", log)
    mark_processed(spark, f"{tmp}/m", unprocessed(spark, log, f"{tmp}/m"))
    assert unprocessed(spark, log, f"{tmp}/m").count() == 0


def test_asof_ignores_null_keys_and_days_without_a_price(spark):
    from datetime import date

    from eventide.operators.fusion import asof_join
    left = spark.createDataFrame([("A", date(2024, 1, 3)), (None, date(2024, 1, 3)), ("A", None)], "k string, d date")
    right = spark.createDataFrame([("A", date(2024, 1, 1), 1.0), (None, date(2024, 1, 1), 2.0), ("A", None, 3.0)], "k string, pd date, v double")
    got = {(r.k, r.d): r.v for r in asof_join(left, right, "k", "d", "pd", ["v"]).collect()}
    assert got == {("A", date(2024, 1, 3)): 1.0, (None, date(2024, 1, 3)): None, ("A", None): None}


def test_spine_takes_its_step(spark):
    from eventide.functions.timefmt import spine
    got = [str(r[0])[11:16] for r in spine(spark, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 12), "5 minutes").collect()]
    assert got == ["00:00", "00:05", "00:10"]


def test_no_private_folder_on_a_cluster():
    from types import SimpleNamespace

    from eventide.session import checkpoint_root
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None,
                         getConf=lambda: SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(SimpleNamespace(sparkContext=sc))
