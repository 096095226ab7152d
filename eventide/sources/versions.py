"""Tables of named parts that change together.

A table is a folder of Parquet parts and a list of which part lies where. A job writes the parts
it changes into a fresh folder, then publishes a new list by one rename that fails if another
writer was first. Readers take the newest list, so they see all of a job or nothing: a job that
dies before the rename leaves files that no list names, and its rerun starts from the list
before it. What a job has to remember (a resume mark, say) goes into the same list.

Parts are hash buckets, days, runs or generations, so a list has as many lines as the table
has parts, whatever their size; it is a small JSON file that only the driver reads. Renaming is
atomic on HDFS-like stores; an object store without it needs one writer at a time.
"""

from __future__ import annotations

import json
import urllib.parse
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

LISTS = "_versions"


class Conflict(RuntimeError):
    """Another writer has published a list since this one's base was read."""


class Part(NamedTuple):
    dir: str
    bytes: int
    files: int


class Snapshot(NamedTuple):
    version: int
    parts: dict[str, Part]
    marks: dict[str, str]


EMPTY = Snapshot(0, {}, {})


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _children(spark: SparkSession, path: str) -> list:
    fs, p = _fs(spark, path)
    return list(fs.listStatus(p)) if fs.exists(p) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    names = [f.getPath().getName() for f in _children(spark, f"{root}/{LISTS}")]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def load(spark: SparkSession, root: str, version: int) -> Snapshot:
    fs, p = _fs(spark, f"{root}/{LISTS}/{version:012d}.json")
    stream = fs.open(p)
    try:
        doc = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Snapshot(version, {k: Part(*v) for k, v in doc["parts"].items()}, doc["marks"])


def current(spark: SparkSession, root: str) -> Snapshot:
    """The newest published list; ``EMPTY`` before the first one."""
    found = versions(spark, root)
    return load(spark, root, found[-1]) if found else EMPTY


def stage(df: DataFrame, root: str, part_col: str) -> dict[str, Part]:
    """Write ``df`` once, a folder per value of ``part_col`` (strings or integers, not NULL), under a
    fresh folder that no list names yet. Values without a row have no part. The caller has
    placed the rows (a bucket in one task, a range per file) and may have sorted them."""
    spark = df.sparkSession
    fresh = f"data/{uuid.uuid4().hex}"
    df.write.partitionBy(part_col).parquet(f"{root}/{fresh}")
    return listed(spark, root, fresh, part_col)


def listed(spark: SparkSession, root: str, fresh: str, part_col: str) -> dict[str, Part]:
    """The parts in a written folder, from its sub-folders' names."""
    out = {}
    for f in _children(spark, f"{root}/{fresh}"):
        name = f.getPath().getName()
        if name.startswith(f"{part_col}="):
            fs, p = _fs(spark, f"{root}/{fresh}/{name}")
            held = fs.getContentSummary(p)
            out[urllib.parse.unquote(name[len(part_col) + 1:])] = Part(f"{fresh}/{name}", held.getLength(), held.getFileCount())
    return out


def commit(spark: SparkSession, root: str, base: Snapshot, parts: dict[str, Part | None],
           marks: dict[str, str] | None = None) -> Snapshot:
    """Publish ``base`` with ``parts`` put in (None: taken out) and ``marks`` set, all at once."""
    now = {k: v for k, v in {**base.parts, **parts}.items() if v is not None}
    made = Snapshot(base.version + 1, now, {**base.marks, **(marks or {})})
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs, draft = _fs(spark, f"{root}/{LISTS}/.{uuid.uuid4().hex}.draft")
    _, final = _fs(spark, f"{root}/{LISTS}/{made.version:012d}.json")
    text = json.dumps({"parts": {k: list(v) for k, v in sorted(now.items())}, "marks": made.marks})
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    keep_existing = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), keep_existing)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {made.version} of {root} was published by another writer") from None
        raise
    return made


def read(spark: SparkSession, root: str, snapshot: Snapshot, schema: str, names: list[str] | None = None) -> DataFrame:
    """The rows of the snapshot's parts (of ``names`` only); other parts' files are not touched."""
    chosen = snapshot.parts.values() if names is None else [snapshot.parts[n] for n in names if n in snapshot.parts]
    paths = [f"{root}/{p.dir}" for p in chosen]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, root: str, keep: int = 2, older_than_hours: float = 24.0) -> list[str]:
    """Remove lists before the newest ``keep``, and folders that no kept list names and that are old
    enough not to belong to a running job. Returns the removed folders."""
    found = versions(spark, root)
    used = {p.dir for v in found[-keep:] for p in load(spark, root, v).parts.values()}
    before = spark.sparkContext._jvm.java.lang.System.currentTimeMillis() - older_than_hours * 3_600_000
    removed = []
    for run in _children(spark, f"{root}/data"):
        fresh = f"data/{run.getPath().getName()}"
        held = [f"{fresh}/{f.getPath().getName()}" for f in _children(spark, f"{root}/{fresh}") if f.isDirectory()]
        if run.getModificationTime() > before:
            continue
        idle = [d for d in held if d not in used]
        # a folder without a used part goes as a whole
        for d in ([fresh] if len(idle) == len(held) else idle):
            fs, p = _fs(spark, f"{root}/{d}")
            fs.delete(p, True)
            removed.append(d)
    for v in found[:-keep]:
        fs, p = _fs(spark, f"{root}/{LISTS}/{v:012d}.json")
        fs.delete(p, False)
    return removed
