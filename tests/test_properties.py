"""Operators against brute-force twins on generated inputs."""

import random
import re
from datetime import date, datetime, timedelta

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventide.functions.text import whole_word_pattern
from eventide.operators import baseline as B
from eventide.operators.fusion import asof_join


def test_asof_join_matches_backward_search(spark):
    rnd = random.Random(7)
    keys = ["K1", "K2", "K3"]
    base = date(2024, 1, 1)
    right = [(k, base + timedelta(days=rnd.randint(0, 200)), float(i)) for i, k in
             enumerate(rnd.choice(keys) for _ in range(150))]
    right = list({(k, d): (k, d, v) for k, d, v in right}.values())  # one price per key and day
    left = [(rnd.choice(keys + ["K4"]), base + timedelta(days=rnd.randint(-20, 230)), i) for i in range(400)]
    L = spark.createDataFrame(left, "k string, d date, i long")
    R = spark.createDataFrame(right, "k string, pd date, v double")
    got = {r.i: (r.pd, r.v) for r in asof_join(L, R, "k", "d", "pd", ["v"]).collect()}
    assert len(got) == len(left)
    for k, d, i in left:
        cands = [(pd_, v) for kk, pd_, v in right if kk == k and pd_ <= d]
        want = max(cands) if cands else (None, None)
        assert got[i] == want, (k, d, i)


def test_dense_equals_sparse_random(spark):
    rnd = random.Random(3)
    t0 = datetime(2024, 1, 1)
    data = [(t0 + timedelta(minutes=15 * rnd.randint(0, 300)), rnd.choice("ABC")) for _ in range(800)]
    df = spark.createDataFrame(data, "interval_ts timestamp_ntz, event_root_code string")
    counts = B.interval_counts(df, ["event_root_code"])
    sig = B.significant_types(counts, 10)
    end = t0 + timedelta(minutes=15 * 250)
    dense = {r.metric_key: r for r in B.baseline_dense(counts, sig, t0, end).collect()}
    sparse = {r.metric_key: r for r in B.baseline_sparse(counts, sig, t0, end).collect()}
    assert dense.keys() == sparse.keys() and dense
    for k in dense:
        assert dense[k].total_occurrences == sparse[k].total_occurrences
        assert abs(dense[k].mean - sparse[k].mean) < 1e-12
        assert abs(dense[k].std_dev - sparse[k].std_dev) < 1e-9
    # pandas twin of the reference's per-type loop
    pdf = pd.DataFrame(data, columns=["ts", "t"])
    full = pd.date_range(t0, end, freq="15min")
    for k, row in dense.items():
        s = pdf[pdf.t == k[-1]].groupby("ts").size().reindex(full, fill_value=0)
        assert abs(s.mean() - row.mean) < 1e-12 and abs(s.std() - row.std_dev) < 1e-9


ALPHABET = st.sampled_from(list("ab .+-_éÉ1\n"))


@settings(max_examples=40, deadline=None)
@given(term=st.text(ALPHABET, min_size=1, max_size=3), text=st.text(ALPHABET, max_size=12))
def test_whole_word_regex_equals_python(spark, term, text):
    py = bool(re.search(r"\b" + re.escape(term) + r"\b", text, re.IGNORECASE))
    got = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(whole_word_pattern(term))).head()[0]
    assert got is py
