"""Tracked-entity mentions in text.

The reference loops over entities and re-scans the file per entity. Here the term list
is a parameter: each term becomes one compiled whole-word pattern, all patterns are
evaluated in one projection over the whole text, and hits are emitted with
``explode`` — one scan, no join between terms and documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.functions.text import MISSING_CONTENT, matches_whole_word


def term_table(spark: SparkSession, terms: list[str]) -> DataFrame:
    """The tracked terms with their list position as priority (a small parameter table)."""
    return spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "entity string, priority int")


def mentions(docs: DataFrame, terms: list[str], text_cols: list[str], id_col: str = "doc_id",
             keep: list[str] | None = None) -> DataFrame:
    """One row ``(entity, priority, id, *keep)`` per document and matching term."""
    if not terms:
        raise ValueError("no terms")
    hits = F.array(*[F.when(matches_whole_word(text_cols, t), F.struct(F.lit(t).alias("entity"),
                                                                       F.lit(i).alias("priority")))
                     for i, t in enumerate(terms)])
    keep = keep or []
    docs = docs.select(id_col, *keep, *text_cols)
    # explode + NULL filter (instead of a higher-order filter) stays in generated code
    return (docs.select(id_col, *keep, F.explode(hits).alias("m"))
            .filter(F.col("m").isNotNull())
            .select("m.entity", "m.priority", id_col, *keep))


def mention_counts(spark: SparkSession, found: DataFrame, terms: list[str]) -> DataFrame:
    """Mentions per term, zero for terms without a hit."""
    counts = found.groupBy("entity").agg(F.count(F.lit(1)).alias("n_mentions"))
    return (term_table(spark, terms).join(counts, "entity", "left")
            .select("entity", "priority", F.coalesce(F.col("n_mentions"), F.lit(0)).cast("bigint").alias("n_mentions")))


def first_mentions(found: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """The first ``k`` mentions of every entity by id (W2); the rank filter lets Spark
    limit each group map-side before the shuffle."""
    w = Window.partitionBy("entity").orderBy(F.col(id_col))
    return (found.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .filter(F.col("rank") <= k))


def first_tracked_entity(found: DataFrame, k: int, id_col: str = "doc_id", show_col: str | None = None) -> DataFrame:
    """The first entity in list order with any hit, its hit count and its first ``k``
    rows (P14, O3, P21). ``found`` should be materialised by the caller when it is
    expensive to recompute, since it is read three times."""
    winner = found.groupBy("priority", "entity").agg(F.count(F.lit(1)).alias("n_mentions")) \
        .orderBy("priority").limit(1)
    chosen = found.join(winner.select("priority", "n_mentions"), "priority")
    w = Window.partitionBy("entity").orderBy(F.col(id_col))
    out = chosen.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
    cols = ["entity", F.col("n_mentions").cast("bigint").alias("n_mentions"), "rank", id_col]
    if show_col:
        cols.append(F.coalesce(F.col(show_col), F.lit(MISSING_CONTENT)).alias("content"))
    return out.select(*cols)
