"""Approximate nearest neighbours by a hierarchical k-means tree and best-bin-first search.

A tree of k-means centres is fitted on a bounded sample (``PER_LEAF`` vectors for each leaf, so
``MAX_LEAVES * PER_LEAF`` at most) in one task. Every vector is indexed: it goes down the tree to
the leaf of its nearest centres. A query walks the tree best bin first: down to the nearest leaf,
with the other children of each node put into a priority queue by distance, then on from the
queue's head. How many leaves it visits is calibrated: for a bounded set of queries the true
neighbours are found in one pass over all vectors, and the visits widen until the walks have met
the wanted share of them. Neighbouring leaves are stored in one shard of ``BLOCK`` vectors, a
larger leaf in several; a query goes once to each shard that holds leaves it visits, and a shard
with many queries is compared in blocks of them. Cosines are in double precision on the vectors.

Equal vectors are one class, which keeps as many of its smallest ids as a result may need, so a
vector with very many copies is compared once and its ties are still answered by smallest id.

The tree is broadcast, with fewer than two nodes per sampled vector at most (``SAMPLE_BOUND``);
everything else is partitioned by shard. Tree, sample and calibration follow from hashes of the
vectors, so reruns agree.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite components, and
rows without id, take no part; vectors of different length are not compared (each length has a
tree of its own); rows that share id and vector count once, and of an id with several vectors
the best cosine counts; fewer candidates give fewer rows; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package, written

EVERY = 50
NEIGHBOURS = 5
#: Children per node, vectors a leaf should hold, and leaves at most.
FANOUT = 8
LEAF_ROWS = 128
MAX_LEAVES = 4096
#: Sampled vectors per leaf, so that the fit's sample holds about ``SAMPLE_BOUND`` at most.
PER_LEAF = 16
SAMPLE_BOUND = MAX_LEAVES * PER_LEAF
LLOYD_STEPS = 12
#: Queries the visits are calibrated with, and the recall they must reach.
CALIBRATION = 256
RECALL = 0.96
#: Vectors of a shard, and queries compared with it at a time.
BLOCK = 16_384


def unit_rows(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    # by the largest component first, so that squares neither overflow nor vanish
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances up to the length of ``v``'s rows."""
    return (centres * centres).sum(axis=1)[None, :] - 2.0 * (v @ centres.T)


def k_means(v: np.ndarray, k: int, rng: np.random.Generator, steps: int = LLOYD_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """At most ``k`` centres, none without a row, and the centre of each row."""
    centres = v[rng.integers(len(v))][None, :]
    away = np.full(len(v), np.inf)
    while len(centres) < k:  # spread first centres: far rows are likelier
        away = np.minimum(away, ((v - centres[-1]) ** 2).sum(axis=1))
        total = away.sum()
        if total <= 1e-18:
            break
        centres = np.vstack([centres, v[min(np.searchsorted(np.cumsum(away), rng.random() * total), len(v) - 1)]])
    own = None
    for _ in range(steps):
        now = _distances(v, centres).argmin(axis=1)
        if own is not None and (now == own).all():
            break
        used, own = np.unique(now, return_inverse=True)
        centres = np.vstack([v[own == j].mean(axis=0) for j in range(len(used))])
    return centres, _distances(v, centres).argmin(axis=1)


class Tree:
    """Nodes with their centres; the children of node i are ``first[i] : first[i] + count[i]``."""

    def __init__(self, centres: np.ndarray, first: np.ndarray, count: np.ndarray):
        self.centres, self.first, self.count = centres, first, count

    @classmethod
    def fit(cls, v: np.ndarray, per_leaf: int = PER_LEAF, fanout: int = FANOUT, seed: int = 0) -> "Tree":
        rng = np.random.default_rng(seed)
        centres, first, count = [v.mean(axis=0)], [0], [0]
        todo = [(0, np.arange(len(v)))]
        while todo:
            node, rows = todo.pop(0)
            if len(rows) <= per_leaf:
                continue
            c, own = k_means(v[rows], min(fanout, -(-len(rows) // per_leaf)), rng)
            parts = [(j, rows[own == j]) for j in range(len(c)) if (own == j).any()]
            if len(parts) < 2:  # equal directions cannot be split
                continue
            first[node], count[node] = len(centres), len(parts)
            for j, part in parts:
                todo.append((len(centres), part))
                centres.append(c[j])
                first.append(0)
                count.append(0)
        return cls(np.vstack(centres), np.array(first), np.array(count))

    def leaf_of(self, v: np.ndarray) -> np.ndarray:
        at = np.zeros(len(v), np.int64)
        moving = np.arange(len(v)) if self.count[0] else np.empty(0, np.int64)
        while len(moving):
            order = moving[np.argsort(at[moving], kind="stable")]
            nodes, starts = np.unique(at[order], return_index=True)
            for node, rows in zip(nodes, np.split(order, starts[1:])):
                kids = self.centres[self.first[node]:self.first[node] + self.count[node]]
                at[rows] = self.first[node] + _distances(v[rows], kids).argmin(axis=1)
            moving = moving[self.count[at[moving]] > 0]
        return at

    def walk(self, distance: np.ndarray) -> Iterator[int]:
        """Leaves best bin first, for a query with these distances to all nodes."""
        d, first, count = distance.tolist(), self.first, self.count
        queue = [(d[0], 0)]
        while queue:
            node = heapq.heappop(queue)[1]
            while count[node]:
                kids = range(first[node], first[node] + count[node])
                near = min(kids, key=d.__getitem__)
                for k in kids:
                    if k != near:
                        heapq.heappush(queue, (d[k], k))
                node = near
            yield node

    def walks(self, v: np.ndarray) -> Iterator[Iterator[int]]:
        for s in range(0, len(v), 256):
            for row in _distances(v[s:s + 256], self.centres):
                yield self.walk(row)


def best(query: np.ndarray, leaves: list[list[int]], rows: np.ndarray, bounds: dict[int, tuple[int, int]],
         ids: list[list[int]], k: int) -> list[list[tuple[float, int]]]:
    """The ``k`` best ``(score, id)`` of each query among the rows of its leaves, best first, ties to
    the smaller id. ``rows`` are sorted by leaf, ``bounds`` has each leaf's first and last row."""
    out = []
    for s in range(0, len(query), 512):
        q = query[s:s + 512]
        visitors: dict[int, list[int]] = {}
        for i, own in enumerate(leaves[s:s + 512]):
            for leaf in own:
                visitors.setdefault(leaf, []).append(i)
        score = np.full((len(q), len(rows)), -np.inf)
        for leaf, who in visitors.items():
            if leaf in bounds:
                a, b = bounds[leaf]
                score[who, a:b] = q[who] @ rows[a:b].T
        cut = np.partition(score, -k, axis=1)[:, -k] - 1e-12 if score.shape[1] > k else np.full(len(q), -np.inf)
        at, hit = np.nonzero((score >= cut[:, None]) & (score > -np.inf))
        exact = np.einsum("ij,ij->i", q[at], rows[hit])  # one pair, one value, whatever the block
        ends = np.searchsorted(at, np.arange(len(q) + 1))
        for i in range(len(q)):
            found = _of_ids(exact[ends[i]:ends[i + 1]], hit[ends[i]:ends[i + 1]], ids)
            if len(found) < k <= len(rows):  # ids with several vectors: all rows of the visited leaves
                every = np.flatnonzero(score[i] > -np.inf)
                found = _of_ids(np.einsum("ij,ij->i", q[[i] * len(every)], rows[every]), every, ids)
            out.append(sorted(((c, x) for x, c in found.items()), key=lambda t: (-t[0], t[1]))[:k])
    return out


def _of_ids(scores: np.ndarray, hits: np.ndarray, ids: list[list[int]]) -> dict[int, float]:
    out: dict[int, float] = {}
    for c, h in zip(scores.tolist(), hits.tolist()):
        for x in ids[h]:
            if c > out.get(x, -np.inf):
                out[x] = c
    return out


_ID = [("h1", pa.int64()), ("h2", pa.int64())]


def _tree_rows(dim: int, per_leaf: int, fanout: int):
    schema = pa.schema([("node", pa.int32()), ("first", pa.int32()), ("count", pa.int32()), ("centre", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = [(b.column(0).to_numpy(), unit_rows(b.column(1), dim)) for b in batches if b.num_rows]
        if keyed:
            order = np.argsort(np.concatenate([k for k, _ in keyed]), kind="stable")
            t = Tree.fit(np.concatenate([v for _, v in keyed])[order], per_leaf, fanout)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(t.count)), pa.int32()), pa.array(t.first, pa.int32()),
                                              pa.array(t.count, pa.int32()), pa.array(list(t.centres), pa.list_(pa.float64()))], schema=schema)

    return run, "node int, first int, count int, centre array<double>"


class TreeIndex:
    """A tree over classes of equal vectors ``(h1, h2, ids, embedding)``, all of length ``dim``."""

    def __init__(self, classes: DataFrame, dim: int, leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT,
                 max_leaves: int = MAX_LEAVES, block: int = BLOCK):
        self.spark, self.dim, self.block = classes.sparkSession, dim, block
        n = classes.count()
        leaves = min(max_leaves, max(1, math.ceil(n / leaf_rows)))
        share = min(1.0, leaves * PER_LEAF / max(n, 1))
        picked = classes.where(F.pmod("h1", F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30))))
        fn, schema = _tree_rows(dim, PER_LEAF, fanout)
        nodes = picked.select("h2", "embedding").repartition(1).mapInArrow(fn, schema).collect()  # bounded by the sample
        if nodes:
            tree = Tree(np.array([r[3] for r in nodes]), np.array([r[1] for r in nodes]), np.array([r[2] for r in nodes]))
        else:  # no vector was picked: one leaf
            tree = Tree(np.zeros((1, dim)), np.zeros(1, int), np.zeros(1, int))
        self.tree = tree
        self.shared = self.spark.sparkContext.broadcast(tree)
        self.table = written(self._placed(classes), "vector-leaves")
        self.leaf_rows = {r[0]: r[1] for r in self.table.groupBy("leaf").count().collect()}  # one row per leaf

    def _placed(self, classes: DataFrame) -> DataFrame:
        shared, dim, at = self.shared, self.dim, classes.columns.index("embedding")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaf = shared.value.leaf_of(unit_rows(b.column(at), dim)) if b.num_rows else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], names=[*b.schema.names, "leaf"])

        return classes.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in classes.dtypes) + ", leaf int")

    def true_neighbours(self, queries: DataFrame, k: int) -> tuple[np.ndarray, list[list[int]]]:
        """A bounded set of queries, by hash, and the leaves of the ``k`` nearest classes of each, from all vectors."""
        n = queries.count()
        share = math.ceil(min(1.0, CALIBRATION / max(n, 1)) * (1 << 30))
        some = queries.where(F.pmod("h2", F.lit(1 << 30)) < share).orderBy("h1", "h2").limit(2 * CALIBRATION).collect()
        if not some:
            return np.empty((0, self.dim)), []
        v = unit_rows(pa.array([r["embedding"] for r in some], pa.list_(pa.float64())), self.dim)
        asked = self.spark.sparkContext.broadcast((v, np.array([r["h1"] for r in some]), np.array([r["h2"] for r in some])))
        dim = self.dim
        schema = pa.schema([("q", pa.int32()), ("score", pa.float64()), ("leaf", pa.int32())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, h1, h2 = asked.value
            for b in batches:
                if not b.num_rows:
                    continue
                score = v @ unit_rows(b.column(2), dim).T
                score[(h1[:, None] == b.column(0).to_numpy()) & (h2[:, None] == b.column(1).to_numpy())] = -np.inf
                m = min(k, b.num_rows)
                top = np.argpartition(-score, m - 1, axis=1)[:, :m]
                q = np.repeat(np.arange(len(v)), m)
                leaf, got = b.column(3).to_numpy()[top.ravel()], score[q, top.ravel()]
                real = np.isfinite(got)
                yield pa.RecordBatch.from_arrays([pa.array(q[real], pa.int32()), pa.array(got[real]), pa.array(leaf[real], pa.int32())], schema=schema)

        found = self.table.select("h1", "h2", "embedding", "leaf").mapInArrow(run, "q int, score double, leaf int")
        nth = Window.partitionBy("q").orderBy(F.desc("score"), "leaf")
        rows = found.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k).select("q", "leaf").collect()
        truth = [[] for _ in some]
        for q, leaf in rows:  # k rows per calibration query
            truth[q].append(leaf)
        asked.unpersist()
        return v, truth

    def visits(self, queries: DataFrame, k: int, recall: float = RECALL) -> int:
        """Leaves to visit: widened until the calibration queries' walks hold that share of their true neighbours."""
        v, truth = self.true_neighbours(queries, k)
        met = np.zeros(len(self.leaf_rows) + len(self.tree.count) + 1, np.int64)
        for walk, leaves in zip(self.tree.walks(v), truth):
            missing = list(leaves)
            for step, leaf in enumerate(walk):
                if not missing:
                    break
                met[step] += missing.count(leaf)
                missing = [x for x in missing if x != leaf]
        wanted, total, step = recall * sum(map(len, truth)), 0, 0
        while total < wanted:
            total += met[step]
            step += 1
        return max(step, 1)

    def shards(self) -> dict[int, tuple[int, int]]:
        """``leaf: (first shard, shards)``: neighbouring leaves are packed into shards of ``block`` rows, a larger leaf is split."""
        out, shard, held, todo = {}, 0, 0, [0]
        while todo:  # depth first, so that a shard holds leaves of one region
            node = todo.pop()
            if self.tree.count[node]:
                todo.extend(range(self.tree.first[node], self.tree.first[node] + self.tree.count[node]))
            elif n := self.leaf_rows.get(node, 0):
                parts = -(-n // self.block)
                if held and held + n > self.block:
                    shard, held = shard + 1, 0
                out[node] = (shard, parts)
                shard, held = (shard, held + n) if parts == 1 else (shard + parts, 0)
        return out

    def search(self, queries: DataFrame, k: int, visits: int) -> DataFrame:
        """``(h1, h2, score, vec_id)``: the ``k`` best ids of each query ``(h1, h2, embedding)`` in the visited leaves."""
        shared, dim, block = self.shared, self.dim, self.block
        places = self.shards()
        at = self.spark.sparkContext.broadcast((self.leaf_rows, places))
        vector = dict(queries.dtypes)["embedding"]

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows_in, place = at.value
            for b in (whole.slice(s, 1024) for whole in batches for s in range(0, whole.num_rows, 1024)):
                row, shard, leaves = [], [], []
                for i, walk in enumerate(shared.value.walks(unit_rows(b.column(2), dim))):
                    met, into = 0, {}
                    for step, leaf in enumerate(walk):
                        if step >= visits and met >= k:  # small leaves: on until enough candidates are met
                            break
                        if leaf in place:
                            for s in range(place[leaf][0], sum(place[leaf])):
                                into.setdefault(s, []).append(leaf)
                            met += rows_in[leaf]
                    row += [i] * len(into)
                    shard += into.keys()
                    leaves += into.values()
                sent = b.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(shard, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))],
                                                 names=[*b.schema.names, "shard", "leaves"])

        routed = written(queries.select("h1", "h2", "embedding").mapInArrow(
            route, f"h1 long, h2 long, embedding {vector}, shard int, leaves array<int>"), "vector-visits")
        # a shard that very many queries visit is compared in blocks of them
        asked = routed.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("n_q")).withColumnRenamed("shard", "s")
        placed = self.spark.createDataFrame([(x, *y) for x, y in places.items()], "l int, start int, parts int")  # a row per leaf
        spread = F.pmod(F.xxhash64("h2", "h1"), F.lit(1 << 30))
        held = (self.table.join(placed, F.col("leaf") == F.col("l"))
                .withColumn("shard", (F.col("start") + spread % F.col("parts")).cast("int")))
        left = (routed.join(asked, F.col("shard") == F.col("s"))
                .select("shard", (spread % F.col("n_q")).cast("int").alias("part"), "h1", "h2", "leaves", F.lit(None).cast("array<bigint>").alias("ids"), "embedding"))
        right = (held.join(asked, F.col("shard") == F.col("s"))
                 .select("shard", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)).alias("part"), "h1", "h2", F.array("leaf").alias("leaves"), "ids", "embedding"))
        schema = pa.schema([*_ID, ("score", pa.float64()), ("vec_id", pa.int64())])

        def compare(key: tuple, t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            asks = pa.compute.is_null(t.column("ids"))
            q, v = t.filter(asks), t.filter(pa.compute.invert(asks))
            if not len(q) or not len(v):
                return schema.empty_table()
            v = v.take(pa.compute.sort_indices(pa.compute.list_element(v.column("leaves"), 0)))
            leaf, starts = np.unique(pa.compute.list_element(v.column("leaves"), 0).to_numpy(), return_index=True)
            bounds = dict(zip(leaf.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(v)])))
            found = best(unit_rows(q.column("embedding"), dim), q.column("leaves").to_pylist(), unit_rows(v.column("embedding"), dim),
                         bounds, v.column("ids").to_pylist(), k)
            at = np.repeat(np.arange(len(q)), [len(x) for x in found])
            flat = [x for xs in found for x in xs]
            return pa.table({"h1": q.column("h1").take(pa.array(at)), "h2": q.column("h2").take(pa.array(at)),
                             "score": pa.array([x[0] for x in flat], pa.float64()),
                             "vec_id": pa.array([x[1] for x in flat], pa.int64())}, schema=schema)

        import pyarrow.compute  # noqa: F401
        found = left.unionByName(right).groupBy("shard", "part").applyInArrow(compare, "h1 long, h2 long, score double, vec_id long")
        nth = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
        found = found.groupBy("h1", "h2", "vec_id").agg(F.max("score").alias("score"))
        return (found.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k)
                .select("h1", "h2", "score", "vec_id"))


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, h1, h2, dim, embedding)`` of the rows that take part; h1 and h2 stand for the vector."""
    e = F.col("embedding")
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    fine = (F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0)
            & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<float>" if kind == "float" else "array<double>").alias("embedding"))
            .where(fine).select("vec_id", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"),
                                F.size("embedding").alias("dim"), "embedding"))


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """Classes of equal vectors with their ``k`` smallest ids; each task sends the rows of a class's ``k`` smallest ids only."""
    nth = Window.partitionBy("h1", "h2").orderBy("vec_id")
    low = rows.withColumn("nth", F.dense_rank().over(nth)).where(F.col("nth") <= k)
    return low.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("dim").alias("dim"),
                                       F.first("embedding").alias("embedding"))


def nearest(vectors: DataFrame, every: int = EVERY, k: int = NEIGHBOURS, recall: float = RECALL, **options) -> DataFrame:
    """The ``k`` nearest other ids of each id divisible by ``every``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = usable_vectors(vectors)
    # the query's own id may be among the smallest of its class
    classes = written(classes_of(rows, k + 1), "vector-classes")
    asking = written(rows.where(F.col("vec_id") % every == 0), "vector-queries")
    parts = []
    for (dim,) in classes.select("dim").distinct().orderBy("dim").collect():  # lengths, not vectors
        index = TreeIndex(classes.where(F.col("dim") == dim).drop("dim"), dim, **options)
        queries = asking.where(F.col("dim") == dim).groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"))
        parts.append(index.search(queries, k + 1, index.visits(queries, k, recall)))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy("h1", "h2").agg(F.collect_list(F.struct("vec_id", "score")).alias("found")) \
        .select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "found")
    own = asking.select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    pairs = (own.join(found, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")))
             .select("query_id", F.explode("found").alias("x")).select("query_id", "x.vec_id", "x.score")
             .where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
