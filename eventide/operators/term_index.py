"""Whole-word mentions of very many tracked terms by a first-word index.

:func:`eventide.operators.mentions.mentions` runs one pattern per term on every text, so its cost
is texts × terms. Here a text is cut once into its runs of word characters and of other
characters. A whole-word match always covers whole runs (a boundary lies at each end, and inside
the term each run is followed by one of the other kind), so a term is a sequence of runs. Every
position of a text is looked up in the set of the terms' first runs; at the few that are in it,
the runs of a term's length (one span per length that any term has) are put together, and these
spans meet the terms in an equi-join. So the cost follows the text and its
hits, whatever the number of terms, and a frequent first word meets no list of terms.

Terms that begin or end with other characters need a word character beyond, as the pattern's
boundary demands; spans are compared as the pattern folds case. Equal to ``mentions`` for every
list of terms; rows with the same id stay rows of their own. The set of first runs is part of the
plan and as large as the list of terms, which the caller holds.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions.text import WORD_CLASS

OTHER_CLASS = WORD_CLASS.replace("[", "[^", 1)
_RUNS = f"{WORD_CLASS}+|{OTHER_CLASS}+"
# the dotted capital I folds to a letter and a combining dot or back, by the order of the steps
_DOTTED_I, _DOT_ABOVE = "\u0130", "\u0307"


def runs(text: Column) -> Column:
    """The runs of word characters and of other characters of a text, in order."""
    return F.regexp_extract_all(text, F.lit(_RUNS), F.lit(0))


def fold(run: Column) -> Column:
    """A key that is equal for runs that differ in case only (and for a few more: hits are compared again)."""
    return F.translate(F.upper(F.lower(run)), _DOTTED_I + _DOT_ABOVE, "I")


class TermIndex(NamedTuple):
    """``entries(entity, priority, span, opens, closes, pattern)``, the first runs and the numbers of runs of all terms."""

    entries: DataFrame
    firsts: list[str]
    lengths: list[int]


def term_index(spark: SparkSession, terms: list[str]) -> TermIndex:
    """The terms with their spans' keys, whether they begin or end with other characters, and their exact patterns."""
    if not terms:
        raise ValueError("no terms")
    if any(not t for t in terms):
        raise ValueError("empty term")
    # an Arrow table is a local relation of known size, so the planner's own size check picks the join
    exact = ["(?iu)\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E" for t in terms]
    rows = spark.createDataFrame(pa.table({"entity": terms, "priority": pa.array(range(len(terms)), pa.int32()), "pattern": exact}))
    rows = rows.withColumn("runs", runs(F.col("entity")))
    heads = rows.select(fold(F.col("runs")[0]).alias("first"), F.size("runs").alias("length")).distinct().collect()
    word = lambda c: c.rlike(f"^{WORD_CLASS}")
    entries = rows.select("entity", "priority", "pattern", fold(F.col("entity")).alias("span"),
                          (~word(F.col("runs")[0])).alias("opens"), (~word(F.element_at("runs", -1))).alias("closes"))
    return TermIndex(entries, sorted({r.first for r in heads}), sorted({r.length for r in heads}))


def indexed_mentions(docs: DataFrame, index: TermIndex, text_cols: list[str], id_col: str = "doc_id",
                     keep: list[str] | None = None) -> DataFrame:
    """:func:`eventide.operators.mentions.mentions` by an index: one row ``(entity, priority, id, *keep)`` per
    document row and matching term."""
    keep = keep or []
    carried = ["__row", id_col, *keep]
    cut = docs.select(F.monotonically_increasing_id().alias("__row"), id_col, *keep, *[
        runs(F.col(c)).alias(f"__t{i}") for i, c in enumerate(text_cols)])
    texts = cut.withColumnRenamed("__t0", "__runs") if len(text_cols) == 1 else cut.select(
        *carried, F.explode(F.array(*[f"__t{i}" for i in range(len(text_cols))])).alias("__runs"))
    # generator, look-up in the set and the spans are one generated loop: no array leaves it
    at, n = F.col("__at"), F.size("__runs")
    places = (texts.select(*carried, "__runs", F.posexplode("__runs").alias("__at", "__run"))
              .filter(fold(F.col("__run")).isin(index.firsts)))
    spans = places.select(*carried, F.explode(F.array(*[
        F.when(at + k <= n, F.struct(F.concat_ws("", F.slice("__runs", at + 1, F.lit(k))).alias("text"), (at > 0).alias("before"),
                                     (at + k < n).alias("beyond"))) for k in index.lengths])).alias("s"))
    hits = (spans.filter(F.col("s").isNotNull()).select(*carried, "s.text", "s.before", "s.beyond")
            .withColumn("__span", fold(F.col("text"))).join(index.entries, F.col("__span") == F.col("span")))
    bounded = (~F.col("opens") | F.col("before")) & (~F.col("closes") | F.col("beyond"))
    # the key folds a little more than the pattern does: beyond ASCII the pattern itself decides
    ascii_only = F.octet_length("text") == F.char_length("text")
    exact = F.when(ascii_only & (F.lower("text") == F.lower("entity")), F.lit(True)).otherwise(
        F.regexp_replace("text", F.col("pattern"), F.lit("")) == "")
    # the spans of one document lie in one task, so the partial aggregate leaves one row per document and term
    return (hits.filter(bounded).filter(exact).groupBy("__row", "priority")
            .agg(*[F.first(c).alias(c) for c in dict.fromkeys(["entity", id_col, *keep])])
            .select("entity", "priority", id_col, *keep))
