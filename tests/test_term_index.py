"""The first-word index against one pattern per term."""

import random

import pytest
from pyspark.sql import functions as F

from eventide.operators import mentions as M
from eventide.operators import term_index as TI

TERMS = ["word", "Word two", "C++", ".NET", "++", "a.b", "a. b", "straße", "ss", "É", "éé", "naïve café", "i", "I", "ſ", "K", "漢字", "two  two",
         "-", "x-", "-x", "a b a", "_u", "u_1", "\\E", "a\\Eb", "ΟΔΟΣ", "ı", "1 2", "é"]
PIECES = ["word", "WORD", "two", "Two", "C", "c", "++", "+", ".NET", ".net", "a", "b", ".", " ", " ", "  ", "straße", "STRASSE", "strasse", "ss",
          "SS", "é", "É", "éé", "naïve", "café", "CAFÉ", "i", "I", "İ", "ı", "ſ", "s", "K", "k", "K", "漢字", "漢", "-", "x", "X", "_u", "u_1",
          "\\E", "\\", "οδος", "ΟΔΟΣ", "οδοσ", "1", "2", "\n", "é", "😀"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equal_to_a_pattern_per_term(spark):
    rng = random.Random(11)
    data = [(i, "".join(rng.choices(PIECES, k=rng.randrange(0, 25))), rng.choice(PIECES), "s") for i in range(400)]
    data += [(3, "word two", None, "t"), (3, "word two", None, "t"), (None, "C++x", "", None), (9, None, None, "u"), (10, "word " * 20_000, "x", "v"), (11, "un naïve CAFÉ, là", "", "w")]
    docs = spark.createDataFrame(data, "doc_id long, text string, other string, source string").repartition(5)
    index = TI.term_index(spark, TERMS)
    for cols in (["text"], ["text", "other"]):
        got = TI.indexed_mentions(docs, index, cols, keep=["source"])
        want = M.mentions(docs, TERMS, cols, keep=["source"])
        assert got.columns == want.columns and rows(got) == rows(want)
    assert {r[0] for r in rows(want)} >= {"C++", ".NET", "straße", "naïve café", "-", "\\E", "ΟΔΟΣ"}


def test_terms_that_differ_in_case_and_lists_of_one(spark):
    docs = spark.createDataFrame([(1, "The end"), (2, "other")], "doc_id long, text string")
    assert rows(TI.indexed_mentions(docs, TI.term_index(spark, ["the", "THE"]), ["text"])) == [("THE", 1, 1), ("the", 0, 1)]
    assert rows(TI.indexed_mentions(docs.limit(0), TI.term_index(spark, ["the"]), ["text"])) == []
    for bad in ([], ["a", ""]):
        with pytest.raises(ValueError):
            TI.term_index(spark, bad)


def test_thousands_of_terms_are_one_lookup(spark):
    """The plan has one generator over the positions and one join, whatever the number of terms."""
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("start"), F.col("id"), F.col("id") * 2, F.lit("end")).alias("text"))
    terms = [f"{i} {2 * i}" for i in range(3000)] + [str(i) for i in range(2000)]
    found = TI.indexed_mentions(docs, TI.term_index(spark, terms), ["text"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("posexplode") >= 1 and plan.count("Join") <= 2 and "rlike" not in plan.lower()
    want = {(f"{i} {2 * i}", i) for i in range(50)} | {(str(k), i) for i in range(50) for k in (i, 2 * i)}
    assert {(r.entity, r.doc_id) for r in found.collect()} == want
