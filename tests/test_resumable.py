"""Runs that resume: a crash at any step neither loses nor repeats rows. Star patterns in one shuffle."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventide.operators import triples as T
from eventide.plans.views import v_triples
from eventide.sources import resumable as RS
from eventide.sources import versions as V

SCHEMA = "id long, interval_ts timestamp_ntz"


def log(spark, n):
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=15 * (i // 3))) for i in range(n)]
    return spark.createDataFrame([*rows, (-1, None)], SCHEMA)


def ids(spark, root):
    return sorted(r.id for r in RS.rows(spark, root, SCHEMA).collect())


@pytest.mark.parametrize("step", ["stage", "commit"])
def test_a_run_that_dies_is_repeated_as_a_whole(spark, tmp, monkeypatch, step):
    root, work = f"{tmp}/r", lambda df: df
    RS.run(spark, root, log(spark, 30), work)
    assert ids(spark, root) == list(range(-1, 30))
    real = getattr(V, step)

    def dies_after(*args):
        if step == "stage":
            real(*args)  # the rows are written
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(V, step, dies_after)
        with pytest.raises(RuntimeError):
            RS.run(spark, root, log(spark, 60), work)
    assert ids(spark, root) == list(range(-1, 30)) and RS.last_processed(V.current(spark, root)) == datetime(2024, 1, 1, 2, 15)
    RS.run(spark, root, log(spark, 60), work)
    RS.run(spark, root, log(spark, 60), work)
    assert ids(spark, root) == list(range(-1, 60)) and V.current(spark, root).version == 2


def test_two_runs_from_one_mark(spark, tmp):
    root = f"{tmp}/r"

    def slow(df):  # another run publishes while this one works
        RS.run(spark, root, log(spark, 12), lambda other: other)
        return df

    with pytest.raises(V.Conflict):
        RS.run(spark, root, log(spark, 12), slow)
    assert ids(spark, root) == list(range(-1, 12))


def test_rows_left_out_by_the_work_are_not_met_again(spark, tmp):
    root = f"{tmp}/r"
    seen = []
    work = lambda df: seen.append(df.count()) or df.filter("id % 2 = 0")
    for n in (9, 9, 18):
        RS.run(spark, root, log(spark, n), work)
    assert seen == [10, 9] and ids(spark, root) == list(range(0, 18, 2))
    RS.run(spark, root, log(spark, 21), lambda df: df.filter("false"))  # a run without result still moves the mark
    assert RS.last_processed(V.current(spark, root)) == datetime(2024, 1, 1, 1, 30)


def test_merged_runs_keep_rows_and_mark(spark, tmp):
    root = f"{tmp}/r"
    for n in (3, 6, 9):
        RS.run(spark, root, log(spark, n), lambda df: df)
    RS.merge_runs(spark, root, SCHEMA, least=4)
    assert len(V.current(spark, root).parts) == 3
    RS.merge_runs(spark, root, SCHEMA, least=3)
    snap = V.current(spark, root)
    assert list(snap.parts) == ["merged-4"] and ids(spark, root) == list(range(-1, 9))
    RS.run(spark, root, log(spark, 12), lambda df: df)
    assert ids(spark, root) == list(range(-1, 12))
    assert RS.rows(spark, f"{tmp}/none", SCHEMA).count() == 0


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_star_equals_the_joins_with_repeated_values(spark):
    rng = random.Random(3)
    triples = []
    for i in range(60):
        s = f"c/{i}"
        triples += [(s, "type", rng.choice(["Country", "Country", "City"]), None)] * rng.choice([0, 1, 1, 2])
        triples += [(s, "label", f"name {rng.randrange(20)}", rng.choice(["en", "de", None])) for _ in range(rng.randrange(3))]
        triples += [(s, "isoCode", f"I{rng.randrange(9)}", None) for _ in range(rng.choice([0, 1, 1, 2]))]
        triples += [(s, "capital", f"c/{rng.randrange(70)}", None) for _ in range(rng.choice([0, 1, 1, 2]))]
    triples += [(None, "type", "Country", None), ("c/0", "label", None, "en"), ("c/1", "capital", None, None), ("c/1", "other", "x", "en")]
    df = spark.createDataFrame(triples, "s string, p string, o string, lang string").filter("s is not null and o is not null")
    for optional in (False, True):
        want = rows(T.country_bindings(df, capital_optional=optional))
        assert want and rows(T.country_star(df, capital_optional=optional)) == want
        assert rows(T.country_star(df, lang="de", capital_optional=optional)) == rows(T.country_bindings(df, "de", optional))
    assert rows(T.country_star(df.limit(0))) == []


def test_star_shuffles_the_store_once(spark):
    df = T.country_star(v_triples(spark, "/root/testdata/sf0.001"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 1 and final.count("FileScan parquet") <= 10  # each branch of the store once
