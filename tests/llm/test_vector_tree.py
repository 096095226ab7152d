"""Nearest neighbours against brute force: recall, exact scores, ties, copies and odd rows."""

import numpy as np
import pytest

from eventide.llm import vector_tree as V
from eventide.llm.common import read_table

SCHEMA = "vec_id long, embedding array<float>, label int, h1 string, ids int, leaf int, rank int, score string"


def frame(spark, ids, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", 2, 3, 4, "y")
                                  for i, v in zip(ids, vectors)], SCHEMA)


def brute(ids, vectors, every=50, k=5):
    """{query_id: [(vec_id, cosine)]} over rows that take part."""
    rows = {(i, tuple(np.float32(v).tolist())) for i, v in zip(ids, vectors)
            if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(v)}
    out = {}
    for q, v in rows:
        if q % every:
            continue
        for i, w in rows:
            if i != q and len(w) == len(v):
                a, b = np.array(v, float), np.array(w, float)
                c = float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
                old = out.setdefault(q, {}).get(i, -2)
                out[q][i] = max(old, c)
    return {q: sorted(found.items(), key=lambda t: (-round(t[1], 12), t[0]))[:k] for q, found in out.items()}


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def clustered(n, dim=16, centres=40, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim)) * 2
    return (c[rng.integers(centres, size=n)] + rng.normal(size=(n, dim))).astype(np.float32)


def test_recall_and_scores_against_brute_force(spark):
    v = clustered(3000)
    ids = list(range(3000))
    got = result(V.nearest(frame(spark, ids, v.tolist()), leaf_rows=32, block=500))
    want = brute(ids, v.tolist())
    assert set(got) == set(want) and all(len(got[q]) == 5 for q in got)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    x = v.astype(float)
    for q, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        for i, s in found:
            assert abs(s - x[q] @ x[i] / np.linalg.norm(x[q]) / np.linalg.norm(x[i])) < 1e-12


def test_given_table(spark):
    df = read_table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = df.collect()
    got, want = result(V.nearest(df)), brute([r.vec_id for r in rows], [r.embedding for r in rows])
    assert set(got) == set(want)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)


def test_few_leaves_are_searched(spark):
    """On clustered vectors the calibrated search meets the recall in a small part of the leaves."""
    rows = V.usable_vectors(frame(spark, range(4000), clustered(4000, dim=8).tolist()))
    index = V.TreeIndex(V.classes_of(rows, 6), 8, leaf_rows=32)
    queries = rows.where("vec_id % 50 = 0").select("h1", "h2", "embedding")
    visits = index.visits(queries, 5)
    assert 1 < visits < len(index.leaf_rows) / 2
    assert index.visits(queries, 5, recall=0.5) < visits <= index.visits(queries, 5, recall=1.0)


def test_a_hot_vector_and_ties(spark):
    """A third of the rows hold one vector: ties go to the smallest ids, own id left out; blocks do not matter."""
    v = clustered(900).tolist()
    for i in range(0, 900, 3):
        v[i] = v[0]
    ids = list(range(900))
    want = brute(ids, v)
    for block in (64, 16_384):
        got = result(V.nearest(frame(spark, ids, v), recall=1.0, leaf_rows=16, block=block))
        assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}
    assert [i for i, _ in got[0]] == [3, 6, 9, 12, 15] and [i for i, _ in got[150]] == [0, 3, 6, 9, 12]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1, 0]), (0, [1, 0]), (1, [2, 0]), (2, [0, 1]), (3, None), (4, []), (5, [0, 0]), (6, [1, None]), (7, [nan, 1]),
            (8, [inf, 1]), (None, [1, 0]), (50, [1, 1, 1]), (51, [1, 1, 0]), (100, [3]), (150, None), (200, [0, 0]),
            (250, [1, 0]), (250, [0, 1]), (9, [1e30, 1e30]), (10, [-1e-30, 1e-30])]
    ids, vectors = zip(*data)
    got, want = result(V.nearest(frame(spark, ids, vectors))), brute(ids, vectors)
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}
    assert all(abs(a - b) < 1e-9 for q in got for (_, a), (_, b) in zip(got[q], want[q]))
    assert set(got) == {0, 50, 250} and len(got[50]) == 1  # the only vector of length 1 has no candidate: no row


def test_empty_table_and_doubles(spark):
    none = V.nearest(spark.createDataFrame([], SCHEMA))
    assert none.columns == ["query_id", "rank", "vec_id", "score"] and none.count() == 0
    df = spark.createDataFrame([(i, [1.0, i / 7]) for i in range(60)], "vec_id long, embedding array<double>")
    assert [i for i, _ in result(V.nearest(df))[50]] == [51, 49, 52, 48, 53]


def test_tree_holds_every_vector_once():
    v = V.unit_rows(__import__("pyarrow").array(clustered(2000).tolist()), 16)
    t = V.Tree.fit(v, per_leaf=10)
    leaves = [i for i in range(len(t.count)) if not t.count[i]]
    assert sorted(t.walk(V._distances(v[:1], t.centres)[0])) == leaves  # a full walk meets each leaf once
    first = [next(w) for w in t.walks(v)]
    assert (t.leaf_of(v) == first).all()
    one = V.Tree.fit(np.ones((50, 4)) / 2, per_leaf=4)  # equal vectors stay in one leaf
    assert len(one.count) == 1 and pytest.approx(one.centres[0]) == [0.5] * 4
