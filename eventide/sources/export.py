"""Event exports: headerless tab-separated files, plain or zipped.

Plain exports are read by Spark's CSV source with an explicit all-string schema wide
enough for the layout; only the 12 kept ordinals are selected, so column pruning reaches
the scan. Zipped exports are read with the ``binaryFile`` source; the only Python on
the rows is the unzip in ``mapInPandas``, which yields raw lines that are split into
columns on the JVM side.
"""

from __future__ import annotations

import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from eventide.functions.nulls import normalize_na
from eventide.functions.timefmt import stamp_from_path
from eventide.session import ship_package

EXPORT_WIDTH = 61

# Ordinal -> name of the twelve kept columns of an event export.
KEPT_COLUMNS = {
    1: "sqldate", 5: "actor1_code", 6: "actor1_name", 15: "actor2_code", 16: "actor2_name",
    26: "event_code", 27: "event_base_code", 28: "event_root_code", 29: "quad_class",
    30: "goldstein_scale", 31: "num_mentions", 34: "avg_tone",
}
NAMES = list(KEPT_COLUMNS.values())
ZIP_GLOB = "*.export.CSV.zip"


def export_schema(width: int = EXPORT_WIDTH) -> StructType:
    return StructType([StructField(f"c{i}", StringType()) for i in range(width)])


def _project(df: DataFrame, get) -> DataFrame:
    cols = [get(i).alias(n) for i, n in KEPT_COLUMNS.items()]
    out = df.select(get(0).alias("source_event_id"), *cols, "source_file",
                    stamp_from_path("source_file").alias("interval_ts"))
    return normalize_na(out, NAMES)


def read_export_tsv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1",
                    glob: str | None = None, width: int = EXPORT_WIDTH) -> DataFrame:
    """Positional scan of plain exports; NA tokens become NULL. Adds the source file name."""
    r = (spark.read.schema(export_schema(width)).option("sep", "\t").option("header", False)
         .option("encoding", encoding).option("mode", "PERMISSIVE"))
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.csv(path).withColumn("source_file", F.col("_metadata.file_name"))
    return _project(df, lambda i: F.col(f"c{i}"))


def export_lines(df: DataFrame, width: int = EXPORT_WIDTH, id_col: str | None = None,
                 keep: list[str] | None = None) -> DataFrame:
    """Event rows as export lines: kept columns at their ordinals, NULL as an empty field."""
    by_pos = {i: F.coalesce(F.col(n), F.lit("")) for i, n in KEPT_COLUMNS.items()}
    if id_col:
        by_pos[0] = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    fields = [by_pos.get(i, F.lit("")) for i in range(width)]
    return df.select(*(keep or []), F.concat_ws("\t", *fields).alias("line"))


def _single_byte(name: str, encoding: str):
    """The column, or an error for a character that a single-byte encoding cannot hold (the
    writer itself would put a question mark)."""
    c = F.col(name)
    if encoding.upper() not in ("ISO-8859-1", "LATIN1", "LATIN-1"):
        return c
    return F.when(c.rlike(r"[^\x{00}-\x{FF}]"), F.raise_error(F.concat(F.lit(f"{name} is not {encoding}: "), c))).otherwise(c)


def write_export_tsv(df: DataFrame, path: str, encoding: str = "ISO-8859-1", id_col: str | None = None,
                     width: int = EXPORT_WIDTH) -> None:
    """Write event rows as plain exports (used to land test data): positional, no header,
    NULL as an empty field, in the export's single-byte encoding."""
    by_pos = {i: _single_byte(n, encoding) for i, n in KEPT_COLUMNS.items()}
    if id_col:
        by_pos[0] = F.col(id_col).cast("string")
    fields = [by_pos.get(i, F.lit(None).cast("string")).alias(f"c{i}") for i in range(width)]
    (df.select(*fields).write.mode("overwrite").option("sep", "\t").option("header", False)
     .option("encoding", encoding).option("nullValue", "").option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("lineSep", "\n").csv(path))


# ---------------------------------------------------------------------------
# zipped exports
# ---------------------------------------------------------------------------

RAW_SCHEMA = "source_file string, status string, line string"
CHUNK_LINES = 50_000
#: Archives that one task fills at a time.
OPEN_ARCHIVES = 512
#: What reading a damaged, encrypted or unsupported archive raises.
ARCHIVE_ERRORS = (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError)


def _unzip_lines(encoding: str):
    def chunks(member):
        """Lines of a member in bounded lists; only \\n ends a line (latin-1 0x85 does not)."""
        part = []
        for line in io.TextIOWrapper(member, encoding=encoding, newline="\n"):
            part.append(line.rstrip("\n").removesuffix("\r"))
            if len(part) == CHUNK_LINES:
                yield part
                part = []
        if part:
            yield part

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                name = path.rsplit("/", 1)[-1]
                status, members = "empty", []
                try:
                    zf = zipfile.ZipFile(io.BytesIO(content))
                    members = [m for m in zf.infolist() if not m.is_dir()]
                    # a pass that only checks: a damaged archive is skipped as a whole
                    if zf.testzip() is not None:
                        status, members = "bad_zip", []
                except ARCHIVE_ERRORS:
                    status, members = "bad_zip", []
                for m in members:
                    if m.file_size:
                        status = "ok"
                        with zf.open(m) as f:
                            for part in chunks(f):
                                yield pd.DataFrame({"source_file": name, "status": "ok", "line": part})
                if status != "ok":
                    yield pd.DataFrame({"source_file": [name], "status": [status], "line": [""]})
    return run


def scan_export_zips(spark: SparkSession, path: str, glob: str = ZIP_GLOB,
                     encoding: str = "latin-1") -> DataFrame:
    """Raw lines of every zipped export with a per-file status (``ok``, ``bad_zip``, ``empty``).

    A corrupt archive or an empty member is not an error: it is reported and skipped,
    as the reference skips such an interval.
    """
    ship_package(spark)
    bins = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return unzipped(bins, encoding)


def unzipped(bins: DataFrame, encoding: str = "latin-1") -> DataFrame:
    """Raw lines ``(source_file, status, line)`` of archives ``(path, content)``."""
    return bins.mapInPandas(_unzip_lines(encoding), RAW_SCHEMA)


def parsed(raw: DataFrame) -> DataFrame:
    """Event rows of raw lines, by the same parser and options as for plain files, so quoted fields read the same."""
    raw = raw.filter((F.col("status") == "ok") & (F.col("line") != ""))
    fields = F.from_csv("line", ", ".join(f"c{i} string" for i in range(EXPORT_WIDTH)), {"sep": "\t", "mode": "PERMISSIVE"})
    return _project(raw.select("source_file", fields.alias("f")), lambda i: F.col(f"f.c{i}"))


def read_export_zips(spark: SparkSession, path: str, glob: str = ZIP_GLOB,
                     encoding: str = "latin-1", observation=None) -> DataFrame:
    """Event rows of all readable zipped exports.

    ``observation`` (a ``pyspark.sql.Observation``) collects, during the same pass, how
    many archives were corrupt or empty and how many lines were read (P20 counters);
    read ``observation.get`` after an action on the result.
    """
    raw = scan_export_zips(spark, path, glob, encoding)
    if observation is not None:
        status = F.col("status")
        raw = raw.observe(observation,
                          F.count(F.when(status == "bad_zip", F.lit(1))).alias("bad_archives"),
                          F.count(F.when(status == "empty", F.lit(1))).alias("empty_archives"),
                          F.count(F.when(status == "ok", F.lit(1))).alias("lines"))
    return parsed(raw)


def zip_scan_report(spark: SparkSession, path: str, glob: str = ZIP_GLOB) -> DataFrame:
    """Files per status: how many intervals were loaded or skipped."""
    raw = scan_export_zips(spark, path, glob)
    return raw.groupBy("status").agg(F.countDistinct("source_file").alias("files"))


def _arrow_uri(path: str) -> str:
    """Hadoop-style path to an Arrow file-system URI (``file:/x`` and ``/x`` -> ``file:///x``)."""
    if path.startswith("file:"):
        return "file:///" + path[5:].lstrip("/")
    if "://" not in path:
        return "file:///" + path.lstrip("/")
    return path


def _zip_writer(root: str, member_suffix: str = ".export.CSV", most_rows: int = 250_000):
    class Archive:
        """An archive that is being filled; only its compressed bytes are held."""

        def __init__(self, name):
            self.name, self.rows, self.buf = name, 0, io.BytesIO()
            self.zip = zipfile.ZipFile(self.buf, "w", zipfile.ZIP_DEFLATED)
            self.member = self.zip.open(name, "w", force_zip64=True)

        def add(self, lines):
            self.member.write(("\n".join(lines) + "\n").encode("latin-1"))
            self.rows += len(lines)

        def land(self, filesystem, base):
            self.member.close()
            self.zip.close()
            with filesystem.open_output_stream(f"{base}/{self.name}.zip") as f:
                f.write(self.buf.getvalue())
            return pd.DataFrame({"file": [self.name + ".zip"], "rows": [self.rows]})

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        ctx = TaskContext.get()
        part = ctx.partitionId() if ctx else 0
        filesystem, base = fs.FileSystem.from_uri(_arrow_uri(root))
        filesystem.create_dir(base, recursive=True)
        filling, n = {}, 0
        for pdf in batches:
            for stamp, grp in pdf.groupby("stamp", sort=True, dropna=False):
                stamp = stamp if isinstance(stamp, str) else "unstamped"
                if stamp not in filling:
                    if len(filling) == OPEN_ARCHIVES:  # the fullest one makes room
                        yield filling.pop(max(filling, key=lambda s: filling[s].rows)).land(filesystem, base)
                    filling[stamp], n = Archive(f"{stamp}-{part:05d}-{n:04d}{member_suffix}"), n + 1
                filling[stamp].add(grp["line"])
                if filling[stamp].rows >= most_rows:
                    yield filling.pop(stamp).land(filesystem, base)
        for archive in filling.values():
            yield archive.land(filesystem, base)
    return run


def write_export_zips(df: DataFrame, path: str, stamp_col: str, id_col: str | None = None,
                      most_rows: int = 250_000) -> DataFrame:
    """Land event rows as zipped exports, an archive per stamp and task, a further one from
    ``most_rows`` rows on; returns ``(file, rows)`` written. File writes go through the Hadoop-compatible Arrow file
    system of the path, so the target may be any shared store Arrow can open."""
    ship_package(df.sparkSession)
    # a task fills its stamps' archives side by side, so its rows need no sort
    lines = export_lines(df.withColumn("stamp", F.col(stamp_col)), id_col=id_col, keep=["stamp"])
    return lines.mapInPandas(_zip_writer(path, most_rows=most_rows), "file string, rows long")


def land_bad_archives(path: str) -> None:
    """Add a file that is no archive, an archive with damaged data and one with an empty member
    to a landing directory, as failed downloads and an empty interval would leave them."""
    from pyarrow import fs

    filesystem, base = fs.FileSystem.from_uri(_arrow_uri(path))
    filesystem.create_dir(base, recursive=True)
    with filesystem.open_output_stream(f"{base}/19990101000000.export.CSV.zip") as f:
        f.write(b"<html>not found</html>")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("19990101003000.export.CSV", b"\t".join(b"damaged" for _ in range(EXPORT_WIDTH)) * 50, zipfile.ZIP_DEFLATED)
        start = zf.infolist()[0].header_offset + 30 + len("19990101003000.export.CSV")
    damaged = bytearray(buf.getvalue())
    damaged[start + 4:start + 12] = b"\xff" * 8
    with filesystem.open_output_stream(f"{base}/19990101003000.export.CSV.zip") as f:
        f.write(bytes(damaged))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("19990101001500.export.CSV", b"")
    with filesystem.open_output_stream(f"{base}/19990101001500.export.CSV.zip") as f:
        f.write(buf.getvalue())
