"""Broken landed files stay and are reported, sound ones are stored and archived after the commit."""

import os

import pytest

from eventide.plans.views import EVENT_COLUMNS
from eventide.sources import edge_store as ES
from eventide.streaming import ingest as SI
from eventide.streaming import quarantine as QU

HEADER = ",".join(["interval_timestamp", *EVENT_COLUMNS])


def row(i, stamp="2024-01-01T00:00:00+00:00"):
    return f"{stamp},20240101,c,A{i},d,B{i},010,010,01,1,-2.0,3,1.5"


def land(folder, name, rows):
    os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join([HEADER, *rows]) + "\n")


def names(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".csv"))


def start(spark, tmp, archive="archive", **opts):
    return QU.start_quarantined_ingest(spark, f"{tmp}/in", f"{tmp}/g", f"{tmp}/ckpt", archive and f"{tmp}/{archive}",
                                       opts.pop("apply", SI.apply_edge_batch), recursive=True, **opts)


def sources(spark, tmp):
    return sorted(r.src for r in ES.edges(spark, f"{tmp}/g").collect())


def test_broken_files_stay_with_their_rows_reported(spark, tmp):
    land(f"{tmp}/in", "a.csv", [row(1), row(2)])
    land(f"{tmp}/in", "day 2/b.csv", [row(3)])
    land(f"{tmp}/in", "long.csv", [row(4), row(5) + ",more"])
    land(f"{tmp}/in", "stamp.csv", [row(6, "soon"), row(7)])
    land(f"{tmp}/in", "empty.csv", [])
    start(spark, tmp, max_files=1).awaitTermination()
    QU.clean_up(spark, f"{tmp}/g", f"{tmp}/in", f"{tmp}/ckpt", f"{tmp}/archive")
    assert sources(spark, tmp) == ["A1", "A2", "A3"]
    assert names(f"{tmp}/in") == ["empty.csv", "long.csv", "stamp.csv"] and names(f"{tmp}/archive") == ["a.csv", "day 2/b.csv"]
    letters = {r.file.rsplit("/", 1)[1]: (r.row, r.reason) for r in QU.dead_letters(spark, f"{tmp}/g").collect()}
    assert letters["long.csv"] == (row(5) + ",more", "fields do not fit the header")
    assert letters["stamp.csv"][0].startswith("soon,20240101") and letters["stamp.csv"][1] == "stamp cannot be read"
    status = {r.file.rsplit("/", 1)[1]: (r.status, r.rows) for r in QU.landed_files(spark, f"{tmp}/g").collect()}
    assert status == {"a.csv": ("loaded", 2), "b.csv": ("loaded", 1), "long.csv": ("broken", 2), "stamp.csv": ("broken", 2)}
    # the repaired file lands under a new name and is loaded
    land(f"{tmp}/in", "long-2.csv", [row(4), row(5)])
    start(spark, tmp).awaitTermination()
    assert sources(spark, tmp) == ["A1", "A2", "A3", "A4", "A5"]


def test_files_of_a_batch_that_died_are_still_there_for_its_replay(spark, tmp):
    land(f"{tmp}/in", "a.csv", [row(1)])
    land(f"{tmp}/in", "b.csv", [row(2)])
    lost = {"n": 0}

    def dies_after_storing(session, root, rows, batch_id):
        SI.apply_edge_batch(session, root, rows, batch_id)
        if batch_id == 1 and not lost["n"]:
            lost["n"] += 1
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        start(spark, tmp, max_files=1, apply=dies_after_storing).awaitTermination()
    assert len(names(f"{tmp}/in")) == 1 and len(names(f"{tmp}/archive")) == 1  # only the committed batch's file has moved
    start(spark, tmp, max_files=1, apply=dies_after_storing).awaitTermination()
    assert sources(spark, tmp) == ["A1", "A2"]  # the replay stored nothing twice
    for _ in range(2):
        QU.clean_up(spark, f"{tmp}/g", f"{tmp}/in", f"{tmp}/ckpt", f"{tmp}/archive")
    assert names(f"{tmp}/in") == [] and names(f"{tmp}/archive") == ["a.csv", "b.csv"]


def test_deletion_instead_of_an_archive(spark, tmp):
    land(f"{tmp}/in", "a.csv", [row(1)])
    start(spark, tmp, archive=None).awaitTermination()
    assert QU.clean_up(spark, f"{tmp}/g", f"{tmp}/in", f"{tmp}/ckpt", None) == 0 and names(f"{tmp}/in") == []
    assert QU.committed_batch(spark, f"{tmp}/none") == -1 and QU.dead_letters(spark, f"{tmp}/none").count() == 0
