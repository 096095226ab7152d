"""Streaming graph ingest from landed interval files.

The file source replaces the directory watcher: every ``*.csv`` landed in the directory
(including those present at start) is read once, with an explicit schema. Each
micro-batch updates the graph tables in ``foreachBatch``:

* event nodes, interaction and impact edges are written under ``batch_id=<n>`` with
  dynamic partition overwrite, so a batch replayed after a failure replaces its own
  output instead of duplicating it;
* actors are kept as an append-only log: each batch writes only its last write per name
  (``actor_deltas/batch_id=<n>``, cost of the batch, not of the table). The actor table
  is last-write-wins over the latest compacted snapshot plus newer deltas; every
  ``compact_every`` batches a new snapshot version is written, and readers take the newest
  complete one, so a snapshot is never overwritten while being read.

Progress lives in the checkpoint; restarting with the same checkpoint resumes without
reprocessing files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventide.operators import graph as G
from eventide.operators.events import accepted_rows, valid_events
from eventide.plans.views import EVENT_COLUMNS
from eventide.session import kept, remove
from eventide.sources import edge_store
from eventide.sources.interval_log import LOG_COLUMNS, parse_iso_utc

LANDED_SCHEMA = LOG_COLUMNS


def landed_interval_files(spark: SparkSession, landing: str, glob: str = "*.csv",
                          clean_source: str | None = None, max_files: int | None = None,
                          recursive: bool = False) -> DataFrame:
    """Streaming frame over headed interval CSV files; ``clean_source`` may be ``delete``
    or ``archive`` (the reference deletes processed files; removal is lazy, G8);
    ``recursive`` also picks up files in sub-directories (a partitioned landing area)."""
    r = (spark.readStream.schema(LANDED_SCHEMA).option("header", True)
         .option("pathGlobFilter", glob))
    if recursive:
        r = r.option("recursiveFileLookup", True)
    if clean_source:
        r = r.option("cleanSource", clean_source)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return (r.csv(landing)
            .withColumn("interval_ts", parse_iso_utc("interval_timestamp"))
            .withColumn("source_file", F.col("_metadata.file_name"))
            .withColumn("block_start", F.col("_metadata.file_block_start")))


def with_event_ids(batch: DataFrame, batch_id: int) -> DataFrame:
    """Unique event ids and a write-order key for one micro-batch, without a shuffle.

    ``event_id`` = batch id + row position. Ids only have to be unique and fixed for the
    batch's outputs: the batch is materialised once (checkpoint) before its tables are
    written, a replayed batch overwrites its own ``batch_id`` partition as a whole, and
    the file source never hands a committed file to a later batch (Q20).
    ``order_key`` orders rows by batch, interval, file name, block and position,
    for last-write-wins; inside one file block the position follows the file's row order.
    """
    pos = F.monotonically_increasing_id()
    rows = batch.withColumn("__pos", pos)
    return (rows.withColumn("event_id", F.concat(F.lit(f"{batch_id}-"), F.col("__pos").cast("string")))
            .withColumn("order_key", F.struct(F.lit(batch_id).cast("bigint").alias("batch"),
                                              F.col("interval_ts"), F.col("source_file"), F.col("block_start"), F.col("__pos")))
            .drop("__pos"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _latest_snapshot(spark: SparkSession, root: str) -> int | None:
    """Batch id of the newest compacted actor snapshot that was written to its end (it has a
    ``_SUCCESS`` file); one that a crash left half-written does not count."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/actors/v=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return max((int(f.getPath().getParent().getName()[2:]) for f in found or ()), default=None)


def actor_writes(spark: SparkSession, root: str) -> DataFrame:
    """``(name, code, ord)`` rows: the current snapshot plus every delta written after it."""
    snap = _latest_snapshot(spark, root)
    parts = []
    if snap is not None:
        parts.append(spark.read.parquet(f"{root}/actors/v={snap}").select("name", "code", "ord"))
    if _exists(spark, f"{root}/actor_deltas"):
        d = spark.read.parquet(f"{root}/actor_deltas")
        if snap is not None:
            d = d.filter(F.col("batch_id") > snap)  # partition pruning on the batch column
        parts.append(d.select("name", "code", "ord"))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _latest(writes: DataFrame) -> DataFrame:
    return writes.groupBy("name").agg(F.max_by("code", "ord").alias("code"), F.max("ord").alias("ord"))


def current_actors(spark: SparkSession, root: str) -> DataFrame:
    writes = actor_writes(spark, root)
    if writes is None:
        return G.empty_graph(spark)["actors"]
    return _latest(writes).select("name", "code", F.lit(G.UNKNOWN_TYPE).alias("type"))


def compact_actors(spark: SparkSession, root: str, batch_id: int) -> None:
    """Write the actor table as snapshot ``v=<batch_id>``; it counts from its ``_SUCCESS`` on."""
    if _latest_snapshot(spark, root) == batch_id:
        return  # replay of a compaction already committed
    writes = actor_writes(spark, root)
    if writes is None:
        return
    _latest(writes).write.mode("overwrite").parquet(f"{root}/actors/v={batch_id}")


def read_graph(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    out = {"actors": current_actors(spark, root)}
    empty = G.empty_graph(spark)
    for name in ("event_nodes", "interactions", "impacts"):
        if _exists(spark, f"{root}/{name}"):
            out[name] = spark.read.parquet(f"{root}/{name}").drop("batch_id")
        else:
            out[name] = empty[name]
    return out


def apply_batch(spark: SparkSession, root: str, batch: DataFrame, batch_id: int,
                compact_every: int | None = 96) -> None:
    rows = accepted_rows(valid_events(batch, text_cols=EVENT_COLUMNS))
    # a written copy fixes ids and positions once for the outputs below, which read only their
    # columns of it, and survives executor loss; replays rewrite the whole batch
    rows, held = kept(with_event_ids(rows, batch_id), "batch")
    tag = F.lit(batch_id).cast("bigint").alias("batch_id")
    outputs = (("event_nodes", G.event_nodes(rows)), ("interactions", G.interaction_edges(rows)),
               ("impacts", G.impact_edges(rows)),
               ("actor_deltas", G.latest_actors(rows, "order_key", lead="interval_ts").select("name", "code", "ord")))
    for name, df in outputs:
        (df.select("*", tag).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(f"{root}/{name}"))
    remove(spark, held)
    if compact_every and (batch_id + 1) % compact_every == 0:
        compact_actors(spark, root, batch_id)


def start_graph_ingest(spark: SparkSession, landing: str, root: str, checkpoint: str,
                       available_now: bool = True, compact_every: int | None = 96,
                       **source_opts) -> StreamingQuery:
    stream = landed_interval_files(spark, landing, **source_opts)
    w = (stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: apply_batch(spark, root, df, bid, compact_every)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def apply_edge_batch(spark: SparkSession, root: str, batch: DataFrame, batch_id: int, compact_every: int = 96,
                     **sizes) -> None:
    """One batch's edges into the clustered edge table under ``root``, compacted every so many batches.
    A replay of a batch that was published adds nothing."""
    rows = with_event_ids(accepted_rows(valid_events(batch, text_cols=EVENT_COLUMNS)), batch_id)
    edges, held = kept(G.interaction_edges(rows), "edges")
    edge_store.add_batch(spark, root, edges, batch_id)
    remove(spark, held)
    if (batch_id + 1) % compact_every == 0:
        edge_store.compact(spark, root, **sizes)


def start_edge_ingest(spark: SparkSession, landing: str, root: str, checkpoint: str, available_now: bool = True,
                      compact_every: int = 96, sizes: dict | None = None, **source_opts) -> StreamingQuery:
    """Landed interval files into the clustered edge table (see :mod:`eventide.sources.edge_store`)."""
    stream = landed_interval_files(spark, landing, **source_opts)
    w = (stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: apply_edge_batch(df.sparkSession, root, df, bid, compact_every, **(sizes or {}))))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
