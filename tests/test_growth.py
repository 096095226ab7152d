"""Steps whose work per task or per row must not grow with the input."""

import os
import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators import graph as G
from eventide.plans import catalog as CA
from eventide.plans.views import EVENT_COLUMNS, v_interactions
from eventide.session import scratch_path
from eventide.sources import edge_store as ES
from eventide.sources import export as EX
from eventide.sources.interval_log import parse_iso_utc
from eventide.streaming import archives as ZS
from eventide.streaming import ingest as SI
from eventide.streaming import quarantine as QU

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_items_are_shuffled_once_and_never_sorted(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        p = plan(v_interactions(spark, SF, with_id=True))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(l_suppkey" not in p and p.count("hashpartitioning(l_orderkey") == 1 and "SortMergeJoin" not in p


def edges(spark, n, seed=1):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    rows = [(f"{i}", pick("A", "B", None, f"C{i % 9}"), pick("x", "y", None), pick("01", "02", None), "1", "1", "1", "1",
             pick(None, *[f"202401{d:02d}" for d in range(10, 30)])) for i in range(n)]
    return spark.createDataFrame(rows, ES.SCHEMA).repartition(4)


def test_only_rows_that_can_be_among_the_newest_are_ranked(spark):
    e = edges(spark, 600)
    got = sorted(map(tuple, G.recent_interactions_all(e, 15).collect()), key=str)
    want, low = [], lambda v: (v is not None, v)
    by = {}
    for r in e.collect():
        by.setdefault(r.src, []).append(r)
    for src, rs in by.items():
        rs.sort(key=lambda r: (low(r.dst), low(r.event_code)))
        rs.sort(key=lambda r: (r.date is None, r.date or ""), reverse=True)
        want += [(src, i, r.dst, r.event_code, r.date) for i, r in enumerate(rs[:15], 1)]
    assert got == sorted(want, key=str)
    assert "__floor" in plan(G.recent_interactions_all(e, 15))


def test_latest_actors_by_their_last_time_equal_those_by_the_whole_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ABC"), rng.choice(["a", None, "b"]), rng.choice(["A", "D", "E"]), rng.choice(["c", None]),
             rng.choice([None, 1, 2, 3]), i) for i in range(200)]
    rows += [("N", "n", "M", "m", None, 300), ("N", "o", "M", None, None, 301)]
    df = spark.createDataFrame(rows, "actor1_name string, actor1_code string, actor2_name string, actor2_code string, t int, i int")
    df = df.withColumn("k", F.struct("t", F.col("i").cast("string"), "i"))
    whole, by_time = (sorted(map(tuple, G.latest_actors(df, "k", **o).collect()), key=str) for o in ({}, {"lead": "t"}))
    assert whole == by_time and len(whole) == 7


def test_more_edges_are_more_ranges(spark, tmp, monkeypatch):
    monkeypatch.setattr(ES, "SORTED_ROWS", 100)
    e = edges(spark, 3_000, seed=3)
    ES.add_batch(spark, f"{tmp}/e", e, 0)
    assert sorted(map(tuple, ES.edges(spark, f"{tmp}/e").collect()), key=str) == sorted(map(tuple, e.collect()), key=str)
    assert ES.file_lines(spark, f"{tmp}/e").count() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def events(spark, n):
    cols = {c: F.lit("1") for c in EVENT_COLUMNS} | {"event_code": F.col("id").cast("string"), "stamp": F.concat(F.lit("200"), (F.col("id") % 3).cast("string"), F.lit("0101000000"))}
    return spark.range(0, n, 1, 1).select(*[c.alias(k) for k, c in cols.items()])


def test_archives_are_filled_side_by_side(spark, tmp, monkeypatch):
    out = EX.write_export_zips(events(spark, 31_000), f"{tmp}/a", "stamp")
    assert "Sort" not in plan(out) and sorted(r["rows"] for r in out.collect()) == [10_333, 10_333, 10_334]
    monkeypatch.setattr(EX, "OPEN_ARCHIVES", 2)
    more = EX.write_export_zips(events(spark, 31_000), f"{tmp}/b", "stamp", most_rows=4_000).collect()
    assert sum(r["rows"] for r in more) == 31_000 and len({r["file"] for r in more}) == len(more) > 6
    for d in ("a", "b"):
        codes = EX.read_export_zips(spark, f"{tmp}/{d}").select("event_code")
        assert codes.count() == codes.distinct().count() == 31_000
    assert len(os.listdir(f"{tmp}/a")) == 3


def test_batches_are_held_as_columns_and_let_go(spark, tmp, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("a batch was checkpointed as rows")

    monkeypatch.setattr(DataFrame, "checkpoint", refused)
    cols = {c: F.lit("1") for c in EVENT_COLUMNS} | {"actor1_name": F.concat(F.lit("N"), (F.col("id") % 5).cast("string"))}
    batch = spark.range(100).select(*[c.alias(k) for k, c in cols.items()], F.lit("f").alias("source_file"), F.lit(0).alias("block_start"),
                                    F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'").alias("interval_ts"))
    SI.apply_batch(spark, f"{tmp}/g", batch, 0)
    g = SI.read_graph(spark, f"{tmp}/g")
    assert g["interactions"].select("event_id").distinct().count() == 100 and g["actors"].count() == 6
    SI.apply_edge_batch(spark, f"{tmp}/e", batch, 0)
    assert ES.edges(spark, f"{tmp}/e").count() == 100
    held = batch.withColumn("interval_timestamp", F.lit("x")).withColumn("_broken", F.lit(None).cast("string")).withColumn("file_path", F.lit("f"))
    assert QU.sort_out(f"{tmp}/q", held, 0).count() == 100
    EX.write_export_zips(events(spark, 50), f"{tmp}/z", "stamp").collect()
    zips = spark.read.format("binaryFile").load(f"{tmp}/z").select("path", "length", "content")
    ZS.store_archives(spark, f"{tmp}/s", zips, 0)
    assert ZS.stored_rows(spark, f"{tmp}/s").count() == 50
    root = scratch_path(spark, "x").rsplit("/", 1)[0]
    names = os.listdir(root.removeprefix("file:")) if os.path.isdir(root.removeprefix("file:")) else []
    assert not [n for n in names if n.startswith(("batch-", "edges-", "unzipped-"))]


def test_the_landed_log_is_written_once(spark):
    assert CA._landed_log(spark, SF) == CA._landed_log(spark, SF)


@pytest.mark.parametrize("text, want", [("2024-01-01T00:15:00+00:00", "2024-01-01 00:15:00"), ("2024-01-01T00:15:00+01:30", "2023-12-31 22:45:00"),
                                        ("2024-01-01T00:15:00Z", "2024-01-01 00:15:00"), ("2024-01-01T00:15:00-02:00", "2024-01-01 02:15:00"),
                                        ("2024-13-01T00:15:00+00:00", "None"), ("+00:00", "None"), (None, "None")])
def test_stamps_with_and_without_offset(spark, text, want):
    got = spark.createDataFrame([(text,)], "s string").select(parse_iso_utc("s").alias("t")).first().t
    assert str(got) == want


def test_a_compressed_log_of_many_partitions_is_written_without_sort_and_read_back(spark, tmp):
    from eventide.sources import interval_log as IL
    n = IL.OPEN_FILES + 6  # more partitions than a task holds open: the rest are written after each other
    rows = (spark.range(4 * n).select(F.expr("TIMESTAMP_NTZ'2001-01-31 00:15:00' + make_ym_interval(0, cast(id % 70 as int))").alias("interval_ts"),
                                      *[F.concat(F.lit(f" {c} €,"), F.col("id").cast("string")).alias(c) for c in EVENT_COLUMNS])
            .unionByName(spark.range(3).select(F.lit(None).cast("timestamp_ntz").alias("interval_ts"), *[F.lit(None).cast("string").alias(c) for c in EVENT_COLUMNS[:-1]],
                                               F.lit("x").alias(EVENT_COLUMNS[-1]))))
    before = spark.conf.get(IL._WRITERS)
    IL.write_interval_log(rows, f"{tmp}/log", granularity="month", compression="gzip")
    assert spark.conf.get(IL._WRITERS) == before
    files = [f for _, _, fs in os.walk(f"{tmp}/log") for f in fs if f.startswith("part-")]
    assert files and all(f.endswith(".csv.gz") for f in files)
    got = IL.read_interval_log(spark, f"{tmp}/log", granularity="month")
    assert got.select("interval_month").distinct().count() == n + 1
    assert sorted(map(str, got.select("interval_ts", *EVENT_COLUMNS).collect())) == sorted(map(str, rows.collect()))
