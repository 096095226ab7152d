"""Helpers shared by the training-data operators: table access, scratch tables, word
columns and connected components."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.session import scratch_path, ship_package

__all__ = ["read_table", "written", "word_count", "components", "empty_text", "released", "ship_package",
           "prefix_sums"]

#: ASCII white space as the contracts write it: ``[\\x20\\x09-\\x0D]``.
WHITE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` once under the shared checkpoint folder, read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Let go of what the driver still holds of finished steps. Spark frees broadcast relations, shuffle
    records and plans once the driver's JVM has collected their handles; a job of very many small
    plans does not wait for a full heap to do so."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def empty_text(c: Column) -> Column:
    """NULL text counts as empty text."""
    return F.coalesce(c, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words (NULL text: 0)."""
    t = F.btrim(empty_text(text), F.lit(WHITE))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, "[ \t-\r]+"))).cast("long")


def prefix_sums(df: DataFrame, by: list[str], order: list[str], amount: str, out: str,
                bucket: Column) -> DataFrame:
    """Exclusive running sum of ``amount`` within ``by`` in ``(bucket, order)`` order.

    No group meets in one task: rows are summed per (``by``, ``bucket``), the bucket totals
    get their own running sum, and the window over rows only spans one bucket. ``bucket``
    must be an integer expression of bounded range that rises with ``order``."""
    from pyspark.sql import Window

    df = df.withColumn("__b", bucket)
    totals = df.groupBy(*by, "__b").agg(F.sum(amount).alias("__t"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)],
                           F.col("__b").alias("__sb"),
                           F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__s"))
    inside = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__i", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    same = F.col("__b") == F.col("__sb")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    return (rows.join(starts, same)
            .withColumn(out, F.col("__s") + F.col("__i"))
            .drop("__b", "__sb", "__s", "__i", *[f"__by{i}" for i in range(len(by))]))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected ``edges(u, v)``: ``(id, component)``, one row per
    id that has an edge; ``component`` is the smallest id of its component.

    Alternating large-star and small-star rounds: each round ties every id to the smallest
    id seen around it, so the number of rounds is logarithmic in a component's width. Every
    step is a partial aggregate and a join on an id; AQE splits the partitions of ids with
    very many neighbours. Each round is written to the shared folder, which cuts the lineage.
    NULL ends and self loops are ignored; no edges give no rows."""
    spark = edges.sparkSession
    e = written(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
                .where("u is not null and v is not null and u <> v")
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = mark(e)
    while last[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, F.col("u") == F.col("k"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        met = large.join(low, F.col("u") == F.col("k"))
        small = (met.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(met.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = written(small, name)
        now = mark(e)
        if now == last:
            break
        last = now
    # a stable round is a set of stars: every id points at the smallest of its component
    stars = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return stars.unionByName(roots)

