"""Landed files that are cleaned up after they are stored, and what becomes of broken ones.

A file with a row that does not fit the header, or whose stamp cannot be read, is not loaded at all
and stays where it landed, as a file whose load fails does; its broken rows go to a dead-letter
table with the file's name and the reason. Files that were loaded are moved to an archive (or
deleted), but only once the batch that read them is committed: until then a replay may have to
read them again. So cleaning looks at batches that the checkpoint calls committed, at the start of
each batch and once more when a run ends, and cleaning twice does nothing.

Tables under ``root``: ``dead_letters(file, row, reason)`` and ``landed_files(file, status, rows)``, both by
``batch_id``; a replayed batch replaces its own. A file without rows is in no batch and stays too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventide.session import kept
from eventide.sources.interval_log import LOG_COLUMNS, parse_iso_utc

LETTER_SCHEMA = "file string, row string, reason string, batch_id bigint"
FILE_SCHEMA = "file string, status string, rows bigint, batch_id bigint"
_BROKEN = "_broken"


def landed_rows(spark: SparkSession, landing: str, glob: str = "*.csv", max_files: int | None = None,
                recursive: bool = False) -> DataFrame:
    """The stream of landed rows with their file's path and, for a row that does not fit, its text in ``_broken``."""
    r = (spark.readStream.schema(f"{LOG_COLUMNS}, {_BROKEN} string").option("header", True).option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", _BROKEN).option("pathGlobFilter", glob))
    if recursive:
        r = r.option("recursiveFileLookup", True)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return (r.csv(landing).withColumn("interval_ts", parse_iso_utc("interval_timestamp"))
            .withColumn("file_path", F.col("_metadata.file_path")).withColumn("source_file", F.col("_metadata.file_name"))
            .withColumn("block_start", F.col("_metadata.file_block_start")))


def _reason() -> Column:
    return (F.when(F.col(_BROKEN).isNotNull(), "fields do not fit the header")
            .when(F.col("interval_ts").isNull(), "stamp cannot be read"))


def _by_batch(df: DataFrame, batch_id: int, path: str) -> None:
    (df.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def sort_out(root: str, batch: DataFrame, batch_id: int) -> DataFrame:
    """Record the batch's files and broken rows and return the rows of its sound files."""
    rows, _ = kept(batch.withColumn("reason", _reason()), "landed")
    files = (rows.groupBy("file_path").agg(F.count("reason").alias("broken"), F.count("*").alias("rows"))
             .select(F.col("file_path").alias("file"), F.when(F.col("broken") > 0, "broken").otherwise("loaded").alias("status"), "rows"))
    _by_batch(files, batch_id, f"{root}/landed_files")
    text = F.coalesce(F.col(_BROKEN), F.to_csv(F.struct(*[c.split()[0] for c in LOG_COLUMNS.split(", ")])))
    letters = rows.filter(F.col("reason").isNotNull()).select(F.col("file_path").alias("file"), text.alias("row"), "reason")
    _by_batch(letters, batch_id, f"{root}/dead_letters")
    broken = letters.select("file").distinct()
    return rows.join(broken, F.col("file_path") == F.col("file"), "left_anti").drop("reason", _BROKEN, "file_path")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def committed_batch(spark: SparkSession, checkpoint: str) -> int:
    """The last batch that the stream's checkpoint calls committed; -1 before the first."""
    fs, p = _path(spark, f"{checkpoint}/commits")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return max((int(n) for n in names if n.isdigit()), default=-1)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    fs, p = _path(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(p) else spark.createDataFrame([], schema)


def dead_letters(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, f"{root}/dead_letters", LETTER_SCHEMA)


def landed_files(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, f"{root}/landed_files", FILE_SCHEMA)


def clean_up(spark: SparkSession, root: str, landing: str, checkpoint: str, archive: str | None, since: int = -1) -> int:
    """Move the loaded files of committed batches after ``since`` to ``archive``, under their path below the landing
    folder (None: delete them). Broken files stay. Returns the last batch cleaned.

    The list holds the files of the batches since the last cleaning, so a run that cleans at every batch
    handles as many names as one batch may read."""
    done = committed_batch(spark, checkpoint)
    if done <= since:
        return since
    names = [r.file for r in landed_files(spark, root).filter((F.col("batch_id") > since) & (F.col("batch_id") <= done)
                                                              & (F.col("status") == "loaded")).select("file").collect()]
    fs, base = _path(spark, landing)
    top = fs.makeQualified(base).toUri()
    uri = spark.sparkContext._jvm.java.net.URI
    for name in names:
        source = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri(name))
        if not fs.exists(source):
            continue  # cleaned before
        if archive is None:
            fs.delete(source, False)
            continue
        below = top.relativize(fs.makeQualified(source).toUri()).getPath().lstrip("/")
        out, target = _path(spark, f"{archive}/{below}")
        out.mkdirs(target.getParent())
        fs.rename(source, target)
    return done


def start_quarantined_ingest(spark: SparkSession, landing: str, root: str, checkpoint: str, archive: str | None,
                             apply: Callable[[SparkSession, str, DataFrame, int], None], available_now: bool = True,
                             **source_opts) -> StreamingQuery:
    """Store the rows of sound files by ``apply(spark, root, rows, batch_id)`` and clean up behind committed batches.
    Call :func:`clean_up` after a run has ended, for its last batch."""
    cleaned = {"to": -1}

    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        cleaned["to"] = clean_up(session, root, landing, checkpoint, archive, cleaned["to"])
        apply(session, root, sort_out(root, batch, batch_id), batch_id)

    w = landed_rows(spark, landing, **source_opts).writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
