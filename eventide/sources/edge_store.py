"""The interaction edges as a stored table that is clustered by source actor.

A :mod:`versions` table whose parts are batches and, after compaction, generations. Every part is
range-clustered by ``(src, date)``, newest first within an actor, so a file holds a narrow range of
actors, or one stretch of time of a very active one; row groups carry min/max and a Bloom filter
on ``src``. Beside each part lies a line per file: its first and last actor, its newest and
oldest date and its rows. A look-up of one actor reads the lines, then only the files whose
range holds the actor, and of a very active actor only the newest files that can hold the
``k`` rows asked for.

Batches of a stream leave small parts. Compaction packs the small ones, largest first, into
groups of the target size, rewrites each group as one clustered generation and publishes all of
them with one list, so the number of parts stays bounded by the table's size over the target plus
one group; a crash before the list changes nothing, and a reader of the old list keeps its files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators.graph import INTERACTION_SCHEMA, recent_interactions
from eventide.sources import versions as V

SCHEMA = INTERACTION_SCHEMA
FILE_SCHEMA = ("part string, file string, first_src string, last_src string, newest string, oldest string, "
               "no_src bigint, no_date bigint, rows bigint")
TARGET_BYTES = 1024 * 2**20
ROWS_PER_FILE = 2_000_000
SORTED_ROWS = 1_000_000
_PART = "__part"
_LINES = "files "


def _order() -> list[Column]:
    return [F.col("src").asc_nulls_first(), F.col("date").desc_nulls_first(), F.col("dst"), F.col("event_code")]


def _clustered(edges: DataFrame, root: str, part: str, rows_per_file: int) -> dict[str, V.Part]:
    """Write ``edges`` as the part ``part`` and the part of its files' lines."""
    spark = edges.sparkSession
    # as many ranges as the rows fill, so that a task sorts a bounded number of them however many there are
    ranges = -(-edges.count() // SORTED_ROWS)
    few = ranges <= spark.sparkContext.defaultParallelism
    out = edges.repartitionByRange(*_order()[:2]) if few else edges.repartitionByRange(ranges, *_order()[:2])
    fresh = f"data/{uuid.uuid4().hex}"
    # straight into the part's folder: a partition column would have the writer sort the rows once more
    if ranges:
        (out.sortWithinPartitions(*_order()).write.option("maxRecordsPerFile", rows_per_file)
         .option("parquet.bloom.filter.enabled#src", "true").option("parquet.bloom.filter.expected.ndv#src", "100000")
         .parquet(f"{root}/{fresh}/{_PART}={part}"))
    made = V.listed(spark, root, fresh, _PART)
    if not made:  # no edges: no part
        return {}
    stored = V.read(spark, root, V.Snapshot(0, made, {}), SCHEMA, [part])
    lines = (stored.groupBy(F.col("_metadata.file_path").alias("path"))
             .agg(F.min("src").alias("first_src"), F.max("src").alias("last_src"), F.max("date").alias("newest"), F.min("date").alias("oldest"),
                  F.count(F.when(F.col("src").isNull(), 1)).alias("no_src"), F.count(F.when(F.col("date").isNull(), 1)).alias("no_date"),
                  F.count("*").alias("rows"))
             .select(F.lit(part).alias("part"), F.concat(F.lit(made[part].dir + "/"), F.regexp_extract("path", "([^/]+)$", 1)).alias("file"),
                     "first_src", "last_src", "newest", "oldest", "no_src", "no_date", "rows", F.lit(_LINES + part).alias(_PART)))
    return {**made, **V.stage(lines.coalesce(1), root, _PART)}


def edge_parts(snapshot: V.Snapshot) -> dict[str, V.Part]:
    return {k: p for k, p in snapshot.parts.items() if not k.startswith(_LINES)}


def add_batch(spark: SparkSession, root: str, edges: DataFrame, batch: int, rows_per_file: int = ROWS_PER_FILE) -> V.Snapshot:
    """Add one batch of a stream. Batches come in order; one that is there already is left out, so a replay adds nothing."""
    base = V.current(spark, root)
    if batch <= int(base.marks.get("last_batch", -1)):
        return base
    names = [f.name for f in spark.createDataFrame([], SCHEMA).schema.fields]
    parts = _clustered(edges.select(*names), root, f"batch-{batch}", rows_per_file)
    return V.commit(spark, root, base, parts, {"last_batch": str(batch)})


def edges(spark: SparkSession, root: str, snapshot: V.Snapshot | None = None) -> DataFrame:
    """All stored edges."""
    snap = V.current(spark, root) if snapshot is None else snapshot
    return V.read(spark, root, snap, SCHEMA, list(edge_parts(snap)))


def file_lines(spark: SparkSession, root: str, snapshot: V.Snapshot | None = None) -> DataFrame:
    """One row per stored file: what a look-up may skip by."""
    snap = V.current(spark, root) if snapshot is None else snapshot
    return V.read(spark, root, snap, FILE_SCHEMA, [k for k in snap.parts if k.startswith(_LINES)])


def files_of(spark: SparkSession, root: str, actor: str, k: int | None = None, snapshot: V.Snapshot | None = None) -> list[str]:
    """The files that may hold edges from ``actor``; with ``k``, those that may hold its ``k`` newest.

    A file of this actor alone whose rows all have a date vouches for its rows: once the newest of
    them hold ``k`` rows, no file whose newest date is before their oldest one can add a row."""
    lines = (file_lines(spark, root, snapshot).filter((F.col("first_src") <= actor) & (F.col("last_src") >= actor))
             .select("file", "newest", "oldest", "no_date", "rows", ((F.col("first_src") == F.col("last_src")) & (F.col("no_src") == 0)).alias("alone")))
    found = lines.collect()  # a line per file of one actor, not per edge
    if k is None:
        return sorted(r.file for r in found)
    floor, held = None, 0
    for r in sorted((r for r in found if r.alone and r.no_date == 0), key=lambda r: r.oldest, reverse=True):
        floor, held = r.oldest, held + r.rows
        if held >= k:
            break
    if held < k:
        return sorted(r.file for r in found)
    return sorted(r.file for r in found if r.no_date or r.newest is None or r.newest >= floor)


def recent(spark: SparkSession, root: str, actor: str, k: int = 15) -> DataFrame:
    """:func:`eventide.operators.graph.recent_interactions` of one actor, from the files that can hold them."""
    snap = V.current(spark, root)
    files = files_of(spark, root, actor, k, snap)
    rows = spark.read.schema(SCHEMA).parquet(*[f"{root}/{f}" for f in files]) if files else spark.createDataFrame([], SCHEMA)
    return recent_interactions(rows, actor, k)


def groups_to_compact(sizes: dict[str, int], target_bytes: int, least: int = 2) -> list[list[str]]:
    """Parts below half the target, packed largest first into groups of at most the target; groups of one are left."""
    groups: list[tuple[int, list[str]]] = []
    for name in sorted((n for n, b in sizes.items() if b < target_bytes / 2), key=lambda n: (-sizes[n], n)):
        for i, (held, members) in enumerate(groups):
            if held + sizes[name] <= target_bytes:
                groups[i] = (held + sizes[name], [*members, name])
                break
        else:
            groups.append((sizes[name], [name]))
    return [members for _, members in groups if len(members) >= least]


def compact(spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, rows_per_file: int = ROWS_PER_FILE) -> V.Snapshot:
    """Rewrite small parts as clustered generations; the edges stay the same."""
    base = V.current(spark, root)
    changes: dict[str, V.Part | None] = {}
    for members in groups_to_compact({k: p.bytes for k, p in edge_parts(base).items()}, target_bytes):
        made = _clustered(V.read(spark, root, base, SCHEMA, members), root, f"generation-{uuid.uuid4().hex[:12]}", rows_per_file)
        changes |= {**{m: None for m in members}, **{_LINES + m: None for m in members}, **made}
    return V.commit(spark, root, base, changes) if changes else base
