"""Physical-plan properties that matter at scale, checked on every registered query."""

import re

import pytest

import __spark_entry__ as E
from eventide.plans.catalog import REGISTRY as QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    df = QUERIES[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_nested_loop_join(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_no_broadcast_hints_in_library():
    import pathlib
    root = pathlib.Path(E.__file__).parent / "eventide"
    pattern = r"\bF\.broadcast\(|\bbroadcast\(|\.hint\(\s*[\"'](broadcast|broadcastjoin|mapjoin)"
    hits = [str(f) for f in root.rglob("*.py") if "llm" not in f.parts and re.search(pattern, f.read_text(), re.IGNORECASE)]
    assert hits == []


def test_scan_pruning_and_pushdown(spark):
    from pyspark.sql import functions as F
    from eventide.plans.views import table
    df = table(spark, SF, "events").filter(F.col("event_type") == "click").select("event_id")
    s = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in s
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in s


def test_export_scan_reads_only_kept_columns(spark, tmp):
    from eventide.plans.views import v_interactions
    from eventide.sources import export as EX
    EX.write_export_tsv(v_interactions(spark, SF).limit(10), f"{tmp}/x")
    s = EX.read_export_tsv(spark, f"{tmp}/x")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in s.splitlines() if "FileScan csv" in line)
    cols = re.findall(r"\bc(\d+)#", scan.split("]")[0])
    assert sorted(map(int, cols)) == [0, 1, 5, 6, 15, 16, 26, 27, 28, 29, 30, 31, 34]  # not all 61


@pytest.mark.parametrize("name", ["actor_recent_interactions_all", "entity_first_mentions"])
def test_top_k_per_group_is_limited_before_the_shuffle(spark, name):
    df = QUERIES[name](spark, SF)
    s = df._jdf.queryExecution().executedPlan().toString()
    # partial WindowGroupLimit below the exchange, final one above it
    assert s.count("WindowGroupLimit") >= 2


def test_cluster_conf_keys_are_spark_sql_settings(spark):
    from eventide.session import cluster_conf
    conf = cluster_conf(input_tb=100, total_cores=8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 100 * 2**40 // (256 * 2**20)
    for key in conf:
        if key.startswith("spark.sql."):
            assert spark.conf.isModifiable(key), key


def test_detection_range_reaches_the_scan(spark):
    df = QUERIES["interval_anomalies"](spark, SF)
    s = df._jdf.queryExecution().executedPlan().toString()
    pushed = [line for line in s.splitlines() if "PushedFilters" in line]
    assert any("GreaterThanOrEqual(ts," in p and "LessThan(ts," in p for p in pushed), pushed


def test_event_rows_meet_the_orders_once(spark):
    """One exchange of the line items at most, on the order key."""
    from eventide.plans.views import v_interactions
    s = v_interactions(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert s.count("hashpartitioning(l_orderkey") <= 1 and "hashpartitioning(l_suppkey" not in s


def test_interval_log_range_prunes_partitions(spark, tmp):
    from datetime import datetime

    from pyspark.sql import functions as F

    from eventide.plans.catalog import _full_event_columns, interval_events
    from eventide.sources import interval_log as IL
    rows = _full_event_columns(interval_events(spark, SF))
    for granularity, column in (("day", "interval_date"), ("month", "interval_month")):
        path = f"{tmp}/{granularity}"
        IL.write_interval_log(rows, path, granularity=granularity)
        a, b = datetime(2024, 1, 3), datetime(2024, 1, 5, 12)
        df = IL.read_interval_log(spark, path, granularity=granularity, start=a, end=b)
        scan = next(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x)
        assert f"({column}#" in scan.split("PartitionFilters")[1]
        assert df.count() == rows.filter((F.col("interval_ts") >= F.lit(a)) & (F.col("interval_ts") < F.lit(b))).count() > 0
        IL.mark_processed(spark, f"{path}-mark", df)
        rest = IL.unprocessed(spark, IL.read_interval_log(spark, path, granularity=granularity), f"{path}-mark")
        scan = next(x for x in rest._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x)
        assert f"({column}#" in scan.split("PartitionFilters")[1]
