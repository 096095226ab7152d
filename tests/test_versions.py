"""Tables of parts that change together, and the bucketed upsert on them."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from eventide.operators import graph as G
from eventide.sources import bucketed as BK
from eventide.sources import versions as V

SCHEMA = "k string, n long"


def put(spark, root, rows, base=None, marks=None):
    df = spark.createDataFrame(rows, "part string, k string, n long")
    base = V.current(spark, root) if base is None else base
    return V.commit(spark, root, base, V.stage(df, root, "part"), marks)


def content(spark, root, names=None, snap=None):
    return sorted(map(tuple, V.read(spark, root, snap or V.current(spark, root), SCHEMA, names).collect()))


def files(root):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{root}/data") for f in fs if f.endswith(".parquet")}


def test_parts_are_put_in_replaced_and_taken_out(spark, tmp):
    root = f"{tmp}/t"
    assert V.current(spark, root) == V.EMPTY and content(spark, root) == []
    put(spark, root, [("a/1", "x", 1), ("b", "y", 2), ("ü =", "z", 3)], marks={"seen": "3"})
    assert set(V.current(spark, root).parts) == {"a/1", "b", "ü ="}  # names that paths must escape
    assert content(spark, root, ["a/1", "ü =", "absent"]) == [("x", 1), ("z", 3)]
    first = V.current(spark, root)
    put(spark, root, [("b", "y", 20)])
    V.commit(spark, root, V.current(spark, root), {"a/1": None})
    now = V.current(spark, root)
    assert now.version == 3 and now.marks == {"seen": "3"} and content(spark, root) == [("y", 20), ("z", 3)]
    assert content(spark, root, snap=first) == [("x", 1), ("y", 2), ("z", 3)]  # an older list still reads
    assert all(p.bytes > 0 and p.files >= 1 for p in now.parts.values())


def test_second_writer_from_one_base_fails_and_leaves_no_trace(spark, tmp):
    root = f"{tmp}/t"
    base = put(spark, root, [("a", "x", 1)])
    put(spark, root, [("b", "y", 2)], base=base)
    with pytest.raises(V.Conflict):
        put(spark, root, [("c", "z", 3)], base=base)
    assert content(spark, root) == [("x", 1), ("y", 2)]
    assert all(f.endswith(".json") for f in os.listdir(f"{root}/_versions") if not f.endswith(".crc"))


def test_vacuum_keeps_what_kept_lists_name(spark, tmp):
    root = f"{tmp}/t"
    put(spark, root, [("a", "x", 1), ("b", "y", 2)])
    for n in range(3):
        put(spark, root, [("b", "y", 10 + n)])
    V.stage(spark.createDataFrame([("q", "lost", 0)], "part string, k string, n long"), root, "part")  # a job that died
    assert V.vacuum(spark, root, keep=1) == []  # too young
    assert len(V.vacuum(spark, root, keep=1, older_than_hours=-1)) == 4
    assert content(spark, root) == [("x", 1), ("y", 12)] and V.versions(spark, root) == [4] and len(files(root)) == 2


def actors(spark, rows):
    return spark.createDataFrame(rows, "actor1_name string, actor1_code string, actor2_name string, actor2_code string, o long")


def test_upsert_reads_and_writes_touched_buckets_only(spark, tmp):
    root = f"{tmp}/a"
    G.merge_stored_actors(spark, root, actors(spark, [(f"A{i}", "c", f"B{i}", None, i) for i in range(500)]), "o", buckets=32)
    before = V.current(spark, root)
    assert len(before.parts) == 32 and all(p.files == 1 for p in before.parts.values())
    held = {f: os.stat(f).st_mtime_ns for f in files(root)}
    # an untouched bucket that cannot be read any more does not matter to a merge elsewhere
    G.merge_stored_actors(spark, root, actors(spark, [("A1", None, "A2", "new", 1)]), "o")
    after = V.current(spark, root)
    changed = {b for b in after.parts if after.parts[b] != before.parts[b]}
    assert 1 <= len(changed) <= 2 and {f: os.stat(f).st_mtime_ns for f in held} == held
    got = {r.name: r.code for r in G.stored_actors(spark, root).collect()}
    assert len(got) == 1000 and got["A1"] is None and got["A2"] == "new" and got["A3"] == "c" and got["B3"] is None
    used = {f"{root}/{p.dir}" for b, p in after.parts.items() if b not in changed}
    for d in used:
        for f in os.listdir(d):
            if f.endswith(".parquet"):
                open(f"{d}/{f}", "w").close()  # emptied: reading it would fail
    G.merge_stored_actors(spark, root, actors(spark, [("A1", "x", "A2", "y", 1)]), "o")
    assert {(r.name, r.code) for r in G.stored_actors(spark, root, ["A1", "A2"]).collect()} == {("A1", "x"), ("A2", "y")}


def test_upsert_equals_the_unbucketed_merge(spark, tmp):
    rng = random.Random(8)
    root, plain = f"{tmp}/a", G.empty_graph(spark)["actors"]
    for b in range(4):
        rows = actors(spark, [(f"N{rng.randrange(40)}", rng.choice([None, "x", "y"]), f"N{rng.randrange(40)}", rng.choice([None, "z"]), i) for i in range(50)])
        G.merge_stored_actors(spark, root, rows, "o", buckets=4)
        plain = G.merge_actor_batch(plain, rows, "o")
    assert sorted(map(tuple, G.stored_actors(spark, root).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    G.merge_stored_actors(spark, root, actors(spark, []), "o")
    assert V.current(spark, root).version == 4  # nothing to write: no new list


def test_created_values_stay_and_null_keys_are_one_key(spark, tmp):
    schema, root = "k string, v long, made string", f"{tmp}/t"
    up = lambda rows: spark.createDataFrame(rows, "k string, v long")
    BK.merge(spark, root, up([("a", 1), (None, 2)]), "k", schema, ["v"], {"made": F.lit("first")}, buckets=4)
    BK.merge(spark, root, up([("a", None), (None, 3), ("b", 4)]), "k", schema, ["v"], {"made": F.lit("second")})
    got = sorted(map(tuple, BK.table(spark, root, schema).collect()), key=str)
    assert got == sorted([("a", None, "first"), (None, 3, "first"), ("b", 4, "second")], key=str)
    assert [tuple(r) for r in BK.table(spark, root, schema, "k", [None]).collect()] == [(None, 3, "first")]


def test_buckets_double_when_they_outgrow_their_size(spark, tmp):
    schema, root = "k string, v long", f"{tmp}/t"
    rows = lambda a, b, v: spark.range(a, b).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(v).alias("v"))
    BK.merge(spark, root, rows(0, 5000, 1), "k", schema, ["v"], {}, buckets=2, bucket_bytes=4000)
    assert BK.bucket_count(V.current(spark, root)) == 2
    size = sum(p.bytes for p in V.current(spark, root).parts.values())
    BK.merge(spark, root, rows(4000, 6000, 2), "k", schema, ["v"], {}, bucket_bytes=4000)
    n = BK.bucket_count(V.current(spark, root))
    assert n >= size / 4000 / 2 and set(V.current(spark, root).parts) <= {str(i) for i in range(n)}
    got = BK.table(spark, root, schema).groupBy("v").count().collect()
    assert {r.v: r["count"] for r in got} == {1: 4000, 2: 2000}
    assert BK.table(spark, root, schema, "k", ["k4500"]).collect()[0].v == 2


def test_one_shuffle_of_the_touched_rows(spark, tmp, monkeypatch):
    """The merge's aggregate and its write share one exchange."""
    seen = []
    stage = V.stage
    monkeypatch.setattr(V, "stage", lambda df, *a: seen.append(df) or stage(df, *a))
    G.merge_stored_actors(spark, f"{tmp}/a", actors(spark, [("A", "c", "B", "d", 1)]), "o", buckets=4)
    assert seen[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_list_is_small_and_readable(spark, tmp):
    root = f"{tmp}/t"
    put(spark, root, [("a", "x", 1)], marks={"last": "7"})
    with open(f"{root}/_versions/{1:012d}.json") as f:
        doc = json.load(f)
    assert doc["marks"] == {"last": "7"} and list(doc["parts"]) == ["a"]
