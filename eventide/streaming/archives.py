"""Zipped exports as a stream: each archive is stored once, as a part of its own.

The file source hands out archives as they land; a batch's archives are unzipped on the executors (the
reader of :mod:`eventide.sources.export`, in bounded chunks of lines) and written as one part per
archive of a :mod:`eventide.sources.versions` table. One commit publishes a batch's parts together with the
batch's number, so a replayed batch adds nothing, and a reader sees whole archives only. What
became of each archive is published with it.

An archive above ``max_bytes`` is not loaded into a row: the length is tested before the content is
read, and the archive is reported as ``too_large``, as a damaged one is as ``bad_zip``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventide.session import kept, remove, ship_package
from eventide.sources import export as EX
from eventide.sources import versions as V

STORED_SCHEMA = "source_event_id string, " + ", ".join(f"{n} string" for n in EX.NAMES) + ", source_file string, interval_ts timestamp_ntz"
REPORT_SCHEMA = "source_file string, status string, lines bigint"
#: Below the two billion bytes that one value of a row can hold.
MAX_BYTES = 2_000_000_000
_PART = "__part"
_REPORT = "report-"


def landed_archives(spark: SparkSession, landing: str, glob: str = EX.ZIP_GLOB, max_files: int | None = None) -> DataFrame:
    """The stream of archives ``(path, length, content)``."""
    r = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
         .option("pathGlobFilter", glob))
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(landing).select("path", "length", "content")


def store_archives(spark: SparkSession, root: str, batch: DataFrame, batch_id: int, encoding: str = "latin-1",
                   max_bytes: int = MAX_BYTES) -> V.Snapshot:
    """Publish the rows of one batch's archives; a batch that was published before is left out."""
    base = V.current(spark, root)
    if batch_id <= int(base.marks.get("last_batch", -1)):
        return base
    ship_package(spark)
    raw = EX.unzipped(batch.filter(F.col("length") <= max_bytes).select("path", "content"), encoding)
    raw, held = kept(raw, "unzipped")  # unzipped once for the rows and the report
    parts = V.stage(EX.parsed(raw).withColumn(_PART, F.col("source_file")), root, _PART)
    large = batch.filter(F.col("length") > max_bytes).select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("source_file"), F.lit("too_large").alias("status"), F.lit(0).cast("bigint").alias("lines"))
    report = (raw.groupBy("source_file", "status").agg(F.count(F.when(F.col("status") == "ok", 1)).alias("lines"))
              .unionByName(large).withColumn(_PART, F.lit(f"{_REPORT}{batch_id}")))
    parts |= V.stage(report, root, _PART)
    remove(spark, held)
    return V.commit(spark, root, base, parts, {"last_batch": str(batch_id)})


def start_archive_ingest(spark: SparkSession, landing: str, root: str, checkpoint: str, available_now: bool = True,
                         max_bytes: int = MAX_BYTES, **source_opts) -> StreamingQuery:
    def run(batch: DataFrame, batch_id: int) -> None:
        store_archives(batch.sparkSession, root, batch, batch_id, max_bytes=max_bytes)

    w = landed_archives(spark, landing, **source_opts).writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def stored_rows(spark: SparkSession, root: str, archives: list[str] | None = None) -> DataFrame:
    """Event rows of the stored archives, or of some by name."""
    snap = V.current(spark, root)
    return V.read(spark, root, snap, STORED_SCHEMA, archives if archives is not None else [p for p in snap.parts if not p.startswith(_REPORT)])


def archive_report(spark: SparkSession, root: str) -> DataFrame:
    """``(source_file, status, lines)`` of every archive met."""
    snap = V.current(spark, root)
    return V.read(spark, root, snap, REPORT_SCHEMA, [p for p in snap.parts if p.startswith(_REPORT)])
