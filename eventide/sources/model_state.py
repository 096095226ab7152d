"""Model-state sink and source.

The native form is one JSON object per line, each a fragment of the reference's
document ``{"event_metrics": {key: {mean, std_dev, total_occurrences}}}``; the union
of all lines' maps is the whole model, so writing and reading stay distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATS = "struct<mean: double, std_dev: double, total_occurrences: bigint>"
DOC_SCHEMA = f"struct<event_metrics: map<string, {STATS}>>"
REQUIRED = "event_metrics"


def _entry(model: DataFrame):
    return F.struct(F.col("mean").cast("double").alias("mean"), F.col("std_dev").cast("double").alias("std_dev"),
                    F.col("total_occurrences").cast("bigint").alias("total_occurrences"))


def model_json_lines(model: DataFrame) -> DataFrame:
    """One ``value`` line per key: ``{"event_metrics": {"<key>": {...}}}``."""
    return model.select(F.to_json(F.struct(
        F.create_map(F.col("metric_key"), _entry(model)).alias(REQUIRED))).alias("value"))


def parse_model_json(lines: DataFrame, col: str = "value") -> DataFrame:
    """JSON lines back to model rows. A line that is no JSON or has no ``event_metrics`` is an error
    in the same pass: a model with a key missing would never score it."""
    text = F.col(col)
    found = lines.select(F.from_json(text, DOC_SCHEMA)[REQUIRED].alias("m"), text.alias("t"))
    bad = F.raise_error(F.concat(F.lit(f"model line without '{REQUIRED}': "), F.coalesce(F.substring("t", 1, 200), F.lit("NULL"))))
    return (found.select(F.explode(F.coalesce(F.col("m"), bad.cast(f"map<string, {STATS}>"))).alias("metric_key", "s"))
            .select("metric_key", "s.mean", "s.std_dev", "s.total_occurrences"))


def write_model_state(model: DataFrame, path: str, fmt: str = "json") -> None:
    if fmt == "json":
        model_json_lines(model).write.mode("overwrite").text(path)
    elif fmt == "parquet":
        model.select("metric_key", "mean", "std_dev", "total_occurrences").write.mode("overwrite").parquet(path)
    else:
        raise ValueError(fmt)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_model_state(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Load a model with the reference's checks: a missing model is an error, and so is
    a model without ``event_metrics`` (S9)."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"model state {path} not found; build the baseline first")
    if fmt == "parquet":
        df = spark.read.parquet(path)
        missing = {"metric_key", "mean", "std_dev", "total_occurrences"} - set(df.columns)
        if missing:
            raise ValueError(f"model state {path} lacks {sorted(missing)}")
        return df
    raw = spark.read.text(path, wholetext=False)
    probe = raw.select(F.from_json("value", f"struct<{REQUIRED}: string>").alias("d"))
    if probe.filter(F.col(f"d.{REQUIRED}").isNotNull()).limit(1).count() == 0:
        raise ValueError(f"model state {path} does not contain '{REQUIRED}'")
    return parse_model_json(raw)
