"""Daily partial sums against a pass over the whole log."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventide.operators import baseline as B
from eventide.operators import incremental as INC
from eventide.plans import params as P
from eventide.plans.catalog import _full_event_columns, interval_events
from eventide.sources import interval_log as IL
from eventide.sources import versions as V

COLS = ["event_root_code", "quad_class"]


def made_up(spark, seed, days=8, per_day=60, off_grid=True):
    rng = random.Random(seed)
    rows = []
    for d in range(days):
        for _ in range(per_day if d != 3 else 0):  # one day has no rows at all
            ts = datetime(2024, 2, 27) + timedelta(days=d, minutes=15 * rng.randrange(96))
            if off_grid and rng.random() < .1:
                ts += timedelta(minutes=7)
            rows.append((ts, rng.choice(["a", "b", None]), rng.choice(["1", "2"])))
    rows += [(None, "a", "1")] * 5
    return spark.createDataFrame(rows, "interval_ts timestamp_ntz, event_root_code string, quad_class string")


def same(a, b):
    key = lambda df: sorted((r.metric_key, round(r.mean, 9), None if r.std_dev is None else round(r.std_dev, 9), r.total_occurrences) for r in df.collect())
    assert key(a) == key(b) and a.columns == b.columns


@pytest.mark.parametrize("seed", [1, 2])
def test_any_range_equals_the_pass_over_the_log(spark, tmp, seed):
    ev, root = made_up(spark, seed), f"{tmp}/p"
    INC.refresh(spark, root, ev, COLS)
    rng = random.Random(seed)
    counts = B.interval_counts(ev, COLS).cache()
    ranges = [(datetime(2024, 2, 27), datetime(2024, 3, 5, 23, 45)), (datetime(2024, 2, 28, 0, 7), datetime(2024, 3, 2)),
              (datetime(2024, 3, 1, 4), datetime(2024, 3, 1, 9)), (datetime(2024, 3, 1), datetime(2024, 3, 1)),
              (datetime(2024, 2, 20), datetime(2024, 3, 20, 23, 45))]
    for _ in range(4):
        a = datetime(2024, 2, 27) + timedelta(minutes=15 * rng.randrange(96 * 8))
        ranges.append((a, a + timedelta(minutes=rng.randrange(6000))))
    for start, end in ranges:
        for least in (0, 100):
            same(INC.model(spark, root, least, start, end), B.sparse_model(counts, least, start, end))
    hour = (datetime(2024, 2, 28), datetime(2024, 3, 2, 22), 3600)  # a coarser spine than the stored grid
    same(INC.model(spark, root, 0, *hour), B.sparse_model(counts, 0, *hour[:2], step_seconds=3600))


def test_build_baseline_is_the_same_model_dense_and_sparse(spark, tmp):
    ev = made_up(spark, 3, off_grid=False)
    start, end = datetime(2024, 2, 27), datetime(2024, 3, 5, 23, 45)
    dense, sparse = (B.build_baseline(ev, COLS, start, end, min_total=50, dense=d) for d in (True, False))
    INC.refresh(spark, f"{tmp}/p", ev, COLS)
    same(dense, sparse)
    same(INC.model(spark, f"{tmp}/p", 50, start, end), sparse)
    assert {r.metric_key for r in sparse.collect()} <= {"event_root_code_a", "event_root_code_b", "quad_class_1", "quad_class_2"}


def test_a_replaced_day_is_read_alone(spark, tmp):
    """After one day is landed anew only that day of the log is read, and other days keep their counts' files."""
    log, root = f"{tmp}/log", f"{tmp}/p"
    rows = _full_event_columns(interval_events(spark, "/root/testdata/sf0.001"))
    IL.write_interval_log(rows, log, fmt="parquet")
    INC.refresh(spark, root, IL.read_interval_log(spark, log, fmt="parquet"), COLS)
    before = V.current(spark, root)
    changed = rows.filter((F.to_date("interval_ts") != F.to_date(F.lit(P.RESTATED_DAY))) | (F.col("quad_class") != "1"))
    IL.write_interval_log(INC.rows_of_days(changed, [P.RESTATED_DAY]), log, fmt="parquet")
    for day in os.listdir(log):  # every other day becomes unreadable
        if day.startswith("interval_date=") and not day.endswith(P.RESTATED_DAY):
            for f in os.listdir(f"{log}/{day}"):
                if f.endswith(".parquet"):
                    open(f"{log}/{day}/{f}", "w").close()
    INC.refresh(spark, root, IL.read_interval_log(spark, log, fmt="parquet"), COLS, [P.RESTATED_DAY])
    after = V.current(spark, root)
    moved = {p for p in after.parts if after.parts[p] != before.parts[p]}
    assert moved == {f"counts-{P.RESTATED_DAY}", f"sums-{P.RESTATED_DAY[:7]}"}
    args = (50, P.BASELINE_START, P.BASELINE_END)
    same(INC.model(spark, root, *args), B.sparse_model(B.interval_counts(changed, COLS), *args))


def test_days_come_and_go(spark, tmp):
    ev, root = made_up(spark, 5), f"{tmp}/p"
    days = [f"{datetime(2024, 2, 27) + timedelta(days=d):%Y-%m-%d}" for d in range(8)]
    for day in [*days, INC.UNDATED]:  # a day at a time, a month's end included
        INC.refresh(spark, root, ev, COLS, [day])
    assert sum(p.startswith("counts-") for p in V.current(spark, root).parts) == 8  # one of the days is empty
    args = (10, datetime(2024, 2, 27), datetime(2024, 3, 5, 23, 45))
    same(INC.model(spark, root, *args), B.sparse_model(B.interval_counts(ev, COLS), *args))
    without = ev.filter((F.to_date("interval_ts") != F.to_date(F.lit(days[0]))) | F.col("interval_ts").isNull())
    INC.refresh(spark, root, without, COLS, days[:1])
    same(INC.model(spark, root, *args), B.sparse_model(B.interval_counts(without, COLS), *args))
    INC.refresh(spark, root, ev.limit(0), COLS)
    assert V.current(spark, root).parts == {} and INC.model(spark, root, *args).collect() == []
    with pytest.raises(ValueError):
        INC.model(spark, root, 0, datetime(2024, 2, 2), datetime(2024, 2, 1))


def test_a_run_that_dies_changes_nothing(spark, tmp, monkeypatch):
    ev, root = made_up(spark, 6), f"{tmp}/p"
    INC.refresh(spark, root, ev, COLS)
    args = (10, datetime(2024, 2, 27), datetime(2024, 3, 5, 23, 45))
    before = INC.model(spark, root, *args).collect()

    def died(*a):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(V, "commit", died)
        with pytest.raises(RuntimeError):
            INC.refresh(spark, root, ev.limit(10), COLS)
    assert INC.model(spark, root, *args).collect() == before
