"""Zipped exports as a stream: equal to the batch scan, each archive once, whatever dies in between."""

import shutil

import pytest

from eventide.plans.catalog import interactions
from eventide.plans.views import EVENT_COLUMNS
from eventide.sources import export as EX
from eventide.sources import versions as V
from eventide.streaming import archives as ZS
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def zips(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("zips"))
    src = interactions(spark, SF).withColumn("stamp", F.concat(F.substring("sqldate", 1, 4), F.lit("0101000000")))
    EX.write_export_zips(src.repartition(2), path, "stamp").collect()
    EX.land_bad_archives(path)
    return path


def rows(df):
    return sorted(map(tuple, df.select(*EVENT_COLUMNS, "source_file").collect()), key=str)


def test_equal_to_the_scan_and_a_replay_adds_nothing(spark, zips, tmp):
    root = f"{tmp}/a"
    lost = {"n": 0}
    commit = V.commit

    def dies_after(*args):
        out = commit(*args)
        lost["n"] += 1
        if lost["n"] == 2:
            raise RuntimeError("lost")  # published, but the stream does not know
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(V, "commit", dies_after)
        with pytest.raises(Exception, match="lost"):
            ZS.start_archive_ingest(spark, zips, root, f"{tmp}/ckpt", max_files=4).awaitTermination()
    ZS.start_archive_ingest(spark, zips, root, f"{tmp}/ckpt", max_files=4).awaitTermination()
    want = EX.read_export_zips(spark, zips)
    assert rows(ZS.stored_rows(spark, root)) == rows(want)
    report = {r.source_file: (r.status, r.lines) for r in ZS.archive_report(spark, root).collect()}
    batch = {r.source_file: r.status for r in EX.scan_export_zips(spark, zips).select("source_file", "status").distinct().collect()}
    assert {k: s for k, (s, _) in report.items()} == batch and {"ok", "bad_zip", "empty"} == set(batch.values())
    name = next(k for k, (s, n) in report.items() if s == "ok")
    assert ZS.stored_rows(spark, root, [name]).count() == report[name][1]


def test_an_archive_over_the_limit_is_reported_and_not_read(spark, zips, tmp):
    landing = f"{tmp}/in"
    shutil.copytree(zips, landing)
    sizes = {r.path.rsplit("/", 1)[1]: r.length for r in spark.read.format("binaryFile").option("pathGlobFilter", EX.ZIP_GLOB).load(landing).select("path", "length").collect()}
    limit = sorted(sizes.values())[-2]
    ZS.start_archive_ingest(spark, landing, f"{tmp}/a", f"{tmp}/ckpt", max_bytes=limit).awaitTermination()
    report = {r.source_file: r.status for r in ZS.archive_report(spark, f"{tmp}/a").collect()}
    assert {k for k, s in report.items() if s == "too_large"} == {k for k, n in sizes.items() if n > limit}
    stored = {r[0] for r in ZS.stored_rows(spark, f"{tmp}/a").select("source_file").distinct().collect()}
    assert stored == {k for k, s in report.items() if s == "ok"}
