"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1. Each source has a weight schedule, linear between its value
at the start and at the end. The share of a source in the whole run is its schedule's
integral; the shares, capped at ``max_epochs`` passes over a source, are its target in words.
Walking through a source's documents (epoch after epoch, each in the order of a hash of the
document's id) uses up the target; the moment of training at which a source's cumulative
demand reaches a document is the document's position, found by inverting the integrated
schedule (a quadratic in time) for every use. Range-sorting by position gives the training order.

Defined results: NULL or blank text has size 0, takes nothing and keeps its row; the NULL
source is a source of its own and comes last in code point order; repeated rows are rows of
their own; an empty table gives an empty result; other columns are ignored by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prefix_sums, word_count

#: Weights by rank of the source in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: How a source's weight at the end of training compares with its weight at the start, by rank.
DRIFT = (0.5, 1.0, 2.0)
BUCKETS = 4096


def source_targets(sizes: DataFrame, total_share: float = 1.5, max_epochs: float = 2.0,
                   weights: tuple = WEIGHTS, drift: tuple = DRIFT) -> DataFrame:
    """``(source, source_size, target, w0, w1)`` from ``sizes(source, size)``.

    The schedule of a source is ``w0 + (w1 - w0) * t`` with integral ``weight``. Water-filling in
    closed form: sources ordered by cap per weight saturate one after another, and the first
    that does not fixes the level for itself and all later ones."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(one) - 1) % len(weights)
    pick = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), (rank + 1).cast("int"))
    per = per.withColumn("weight", pick(weights)).withColumn("drift", pick(drift))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    per = per.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    done = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(total_share))
    level = (total - F.coalesce(F.sum("cap").over(done), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level)
    first_free = F.min(F.when(F.col("ratio") > F.col("level"), F.col("ratio"))).over(everything)
    free_level = F.min(F.when(F.col("ratio") == first_free, F.col("level"))).over(everything)
    target = F.when(F.col("ratio") < first_free, F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * free_level))
    w0 = 2.0 * F.col("weight") / (1.0 + F.col("drift"))
    return per.select("source", "source_size", F.coalesce(target, F.col("cap")).alias("target"),
                      w0.alias("w0"), (w0 * F.col("drift")).alias("w1"))


def time_of(share: Column, w0: Column, w1: Column) -> Column:
    """The time in [0, 1] at which the integral of ``w0 + (w1 - w0) t`` has reached ``share`` of
    its value at 1."""
    need = share * (w0 + w1) / 2.0
    slope = w1 - w0
    # the root of slope/2 t^2 + w0 t = need in the form that stays exact for slope 0
    root = 2.0 * need / (w0 + F.sqrt(F.greatest(w0 * w0 + 2.0 * slope * need, F.lit(0.0))))
    return F.least(F.greatest(root, F.lit(0.0)), F.lit(1.0))


def mix(docs: DataFrame, total_share: float = 1.5, max_epochs: float = 2.0,
        weights: tuple = WEIGHTS, drift: tuple = DRIFT) -> DataFrame:
    """One row per document of ``docs(doc_id, text, source)``: doc_id, size, source_size, target,
    taken, source, position, last_position, positions, range-sorted into training order by the first use (unused
    documents last).

    ``taken`` counts the words the mix takes of the document: a full pass of its source takes
    the whole document, the last pass takes what the target still needs, which cuts one
    document per source. ``positions`` holds the time of each of its uses, one per pass that takes words of
    it; ``position`` and ``last_position`` are the first and the last of them (all NULL when it is not used)."""
    sizes = docs.select("doc_id", F.col("source"), word_count(F.col("text")).alias("size"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sizes = sizes.withColumn("__k", key)
    targets = source_targets(sizes, total_share, max_epochs, weights, drift)
    bucket = F.conv(F.substring("__k", 1, 3), 16, 10).cast("int")
    rows = prefix_sums(sizes, ["source"], ["__k", "doc_id", "size"], "size", "start", bucket)
    t = targets.withColumnRenamed("source", "__s")
    rows = rows.join(t, rows["source"].eqNullSafe(t["__s"])).drop("__s", "__k")
    goal = F.round(F.col("target")).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = goal - passes * F.col("source_size")
    part = F.least(F.greatest(left - F.col("start"), F.lit(0)), F.col("size"))
    taken = passes * F.col("size") + part
    at = lambda words: time_of(words / F.greatest(goal, F.lit(1)), F.col("w0"), F.col("w1"))
    last_pass = F.when(part > 0, passes).otherwise(passes - 1)
    reached = F.transform(F.sequence(F.lit(0).cast("long"), last_pass), lambda k: at(k * F.col("source_size") + F.col("start")))
    rows = rows.select(
        "doc_id", "size", "source_size", F.col("target").cast("double").alias("target"),
        taken.cast("long").alias("taken"), "source",
        F.when(taken > 0, at(F.col("start"))).alias("position"),
        F.when(taken > 0, at(last_pass * F.col("source_size") + F.col("start"))).alias("last_position"),
        F.when(taken > 0, reached).alias("positions"))
    order = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def in_training_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix uses them: one row per use, range-sorted by position.

    A document used more than once comes once per pass at that pass's position. Whole documents
    only: the document that a source's target cuts is used in full when at least half of it is
    needed, so a source misses its target by half a document at most. All columns of ``docs``
    stay as they are."""
    plan = mix(docs, **options)
    # rows may repeat an id: the n-th row of an id, by size and source, meets its own plan row
    def numbered(df: DataFrame) -> DataFrame:
        nth = Window.partitionBy("doc_id").orderBy("size", F.coalesce(F.col("source"), F.lit("")))
        return df.where("size > 0").withColumn("nth", F.row_number().over(nth))

    whole = F.floor(F.col("taken") / F.col("size"))
    rest = F.col("taken") - whole * F.col("size")
    uses = (whole + F.when(2 * rest >= F.col("size"), 1).otherwise(0)).cast("int")
    plan = (numbered(plan.drop("source_size", "target")).withColumn("uses", uses).where("uses > 0")
            .select("doc_id", "nth", "uses", "positions"))
    # the documents travel as one struct, so that no column of theirs can clash
    rows = numbered(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                                F.struct(*docs.columns).alias("row")))
    rows = rows.select(F.col("doc_id").alias("id"), F.col("nth").alias("n"), "row")
    used = rows.join(plan, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("n") == F.col("nth")))
    used = used.select("row", "doc_id", F.explode(F.slice("positions", 1, F.col("uses"))).alias("at"))
    return (used.repartitionByRange(F.col("at"), F.col("doc_id")).sortWithinPartitions("at", "doc_id")
            .select("row.*"))
