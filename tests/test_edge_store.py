"""The clustered edge table: look-ups read few files, compaction keeps the edges and bounds the files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from eventide.operators import graph as G
from eventide.sources import edge_store as ES
from eventide.sources import versions as V


def made_up(spark, n, seed=1, actors=40, hot=0.35):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        src = "HOT" if rng.random() < hot else f"A{rng.randrange(actors):03d}"
        date = None if rng.random() < .002 and src != "HOT" else f"2024{rng.randrange(1, 13):02d}{rng.randrange(1, 29):02d}"
        rows.append((f"{seed}-{i}", src, f"B{rng.randrange(30)}", f"{rng.randrange(1, 20):02d}", "1", "2", "3", "4", date))
    return spark.createDataFrame(rows, ES.SCHEMA).repartition(8)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_look_ups_equal_the_full_scan_and_read_few_files(spark, tmp):
    root = f"{tmp}/e"
    all_edges = made_up(spark, 12_000)
    for b in range(3):
        ES.add_batch(spark, root, all_edges.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == b), b, rows_per_file=200)
    ES.compact(spark, root, rows_per_file=200)
    total = ES.file_lines(spark, root).count()
    assert total >= 60
    same(ES.edges(spark, root), all_edges)
    for actor in ("HOT", "A000", "A017", "A039", "absent", ""):
        for k in (1, 15, 10_000):
            same(ES.recent(spark, root, actor, k), G.recent_interactions(all_edges, actor, k))
    assert len(ES.files_of(spark, root, "A017")) <= 4
    every, newest = ES.files_of(spark, root, "HOT"), ES.files_of(spark, root, "HOT", 15)
    assert len(every) >= 20 and len(newest) <= 4  # the newest stretch of the very active actor
    plan = ES.recent(spark, root, "A017", 15)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(src,A017)" in plan  # row groups are skipped by min/max and the Bloom filter


def test_other_files_are_not_opened(spark, tmp):
    root = f"{tmp}/e"
    all_edges = made_up(spark, 6_000, seed=2)
    ES.add_batch(spark, root, all_edges, 0, rows_per_file=150)
    want = G.recent_interactions(all_edges, "A020", 15).collect()
    keep = set(ES.files_of(spark, root, "A020", 15))
    part = ES.edge_parts(V.current(spark, root))["batch-0"]
    for f in os.listdir(f"{root}/{part.dir}"):
        if f.endswith(".parquet") and f"{part.dir}/{f}" not in keep:
            open(f"{root}/{part.dir}/{f}", "w").close()
    assert ES.recent(spark, root, "A020", 15).collect() == want


def test_row_groups_carry_statistics_and_a_bloom_filter(spark, tmp):
    """Few actors a file: dictionary and min/max skip row groups; many: the writer adds the Bloom filter."""
    root = f"{tmp}/e"
    many = spark.range(400_000).select(*[F.concat(F.lit(f"{c} of a long list "), F.col("id")).alias(c) if c in ("event_id", "src") else F.lit("x").alias(c)
                                         for c in spark.createDataFrame([], ES.SCHEMA).columns])
    ES.add_batch(spark, root, many, 0)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    offsets = []
    for r in ES.file_lines(spark, root).collect():
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{r.file}")
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
        for block in reader.getFooter().getBlocks():
            column = next(c for c in block.getColumns() if c.getPath().toDotString() == "src")
            assert column.getStatistics().hasNonNullValue()
            offsets.append(column.getBloomFilterOffset())
        reader.close()
    assert max(offsets) > 0
    assert ES.recent(spark, root, "src of a long list 77", 3).count() == 1


def test_many_batches_leave_few_files(spark, tmp):
    root = f"{tmp}/e"
    edges = made_up(spark, 1_000, seed=3).cache()
    n = 40
    for b in range(n):
        ES.add_batch(spark, root, edges.filter(F.pmod(F.xxhash64("event_id"), F.lit(n)) == b), b)
        if b % 8 == 7:
            ES.compact(spark, root)
            assert len(ES.edge_parts(V.current(spark, root))) == 1
    same(ES.edges(spark, root), edges)
    files = sum(p.files for p in ES.edge_parts(V.current(spark, root)).values())
    assert files <= 2 * spark.sparkContext.defaultParallelism + 2
    assert len(V.vacuum(spark, root, keep=1, older_than_hours=-1)) > n
    same(ES.edges(spark, root), edges)


def test_packing_of_parts_is_bounded():
    rng = random.Random(4)
    sizes = {f"batch-{i}": rng.randrange(1, 300) for i in range(200)} | {"generation-x": 900, "generation-y": 5000}
    groups = ES.groups_to_compact(sizes, 1000)
    members = [m for g in groups for m in g]
    assert len(members) == len(set(members)) and "generation-x" not in members and "generation-y" not in members
    assert all(2 <= len(g) and sum(sizes[m] for m in g) <= 1000 for g in groups)
    small = sum(b for b in sizes.values() if b < 500)
    assert len(groups) <= 2 * small / 1000 + 1  # two groups together are over the target
    assert ES.groups_to_compact({"a": 10}, 1000) == [] and ES.groups_to_compact({}, 1000) == []


def test_replay_adds_nothing_and_a_dead_compaction_changes_nothing(spark, tmp, monkeypatch):
    root = f"{tmp}/e"
    a, b = made_up(spark, 300, seed=5), made_up(spark, 300, seed=6)
    ES.add_batch(spark, root, a, 0)
    ES.add_batch(spark, root, b, 1)
    ES.add_batch(spark, root, b, 1)  # the stream replays its last batch
    same(ES.edges(spark, root), a.unionByName(b))

    def died(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(V, "commit", died)
        with pytest.raises(RuntimeError):
            ES.compact(spark, root)
    before = V.current(spark, root)
    ES.compact(spark, root)
    ES.add_batch(spark, root, b, 1)  # also after compaction took the batch's part away
    same(ES.edges(spark, root), a.unionByName(b))
    same(ES.edges(spark, root, before), a.unionByName(b))  # a reader of the old list still has its files
    ES.add_batch(spark, root, a.limit(0), 2)
    assert V.current(spark, root).marks["last_batch"] == "2"
