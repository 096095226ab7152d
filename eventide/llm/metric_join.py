"""Exact near-duplicate join of embeddings by pivots and the triangle inequality.

On unit vectors the cosine bound is a distance bound ``r``. Pivots (vectors picked by hash)
split the vectors of a label into cells by their nearest pivot. A vector is also copied into
every cell that may hold a neighbour of it: if y lies within r of some x of cell i, then
``d(y, p_i) <= d(y, p_own) + 2 r`` by the triangle inequality, and y is at most r beyond the
bisecting plane of the two pivots; a copy is made only where both hold. Cells then join on
their own: each counts the neighbours of its own vectors and reports which vectors hang
together, one row per vector, never the pairs.

Equal vectors of a label are one class with a count. A cell with many vectors is split into
blocks of own vectors by blocks of candidates, so a task holds at most two blocks.

Defined results: a vector that is NULL, empty, zero, holds NULL or non-finite components or has
no label links with nothing and is its own component; vectors of different length never link;
rows that repeat a vector link with each other; a NULL id is counted as a neighbour, its own
component takes the smallest id that is not NULL; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, ship_package, written

COSINE = 0.98
#: Vectors per pivot at least; with more than ``MAX_PIVOTS`` times as many, cells get larger.
CELL = 1024
#: All pivots together, which are broadcast (bounded: a few MB).
MAX_PIVOTS = 2048
#: Vectors per block of a split cell.
BLOCK = 4096


def radius(cosine: float) -> float:
    """Distance of unit vectors at that cosine, a little wider against rounding."""
    return math.sqrt(max(0.0, 2.0 - 2.0 * cosine)) + 1e-6


def unit_rows(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(-1, dim)
    # scaled by the largest component first, so that squares neither overflow nor vanish
    v = v / np.abs(v).max(axis=1)[:, None]
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def cells_of(v: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """The own cell of each row of ``v``, and a mask of all cells that get a copy of it."""
    d2 = np.maximum(2.0 - 2.0 * (v @ pivots.T), 0.0)
    own = d2.argmin(axis=1)
    d = np.sqrt(d2)
    mine = d[np.arange(len(v)), own][:, None]
    between = np.sqrt(np.maximum(2.0 - 2.0 * (pivots @ pivots.T), 0.0))[own]
    near = (d <= mine + 2 * r) & (d2 - mine * mine <= 2 * r * between + 1e-9)
    near[np.arange(len(v)), own] = True
    return own, near


def _dealt(pivots, r: float):
    """Each class into its own cell and the cells that need a copy of it."""
    schema = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("own", pa.bool_()),
                        ("cid", pa.int64()), ("copies", pa.int64()), ("embedding", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pivots.value
        for b in batches:
            keys = list(zip(b.column("label").to_pylist(), b.column("dim").to_pylist()))
            for key in set(keys):
                at = np.array([i for i, k in enumerate(keys) if k == key])
                part = b.take(pa.array(at))
                p = table.get(key)
                if p is None:
                    rows, cell, own = np.arange(len(at)), np.zeros(len(at), np.int32), np.ones(len(at), bool)
                else:
                    mine, near = cells_of(unit_rows(part.column("embedding"), key[1]), p, r)
                    rows, cell = np.nonzero(near)
                    own = mine[rows] == cell
                part = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), part.column("dim"), pa.array(cell, pa.int32()), pa.array(own),
                     part.column("cid"), part.column("copies"), part.column("embedding").cast(pa.list_(pa.float64()))],
                    schema=schema)

    return run, "label long, dim int, cell int, own boolean, cid long, copies long, embedding array<double>"


def joined(own: np.ndarray, own_ids: np.ndarray, cand: np.ndarray, cand_ids: np.ndarray, copies: np.ndarray,
           cosine: float, step: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours of each own row (itself included) and ``(id, root)`` of all rows with a link,
    where rows that hang together in this block share a root."""
    total = np.zeros(len(own), np.int64)
    hits = []
    for k in range(0, len(own), step):
        linked = own[k:k + step] @ cand.T >= cosine
        total[k:k + step] = linked @ copies
        linked &= own_ids[k:k + step, None] != cand_ids[None, :]
        q, c = np.nonzero(linked.any(axis=1))[0], np.nonzero(linked.any(axis=0))[0]
        if len(q):
            hits.append((q + k, c, linked[np.ix_(q, c)]))
    ids = np.concatenate([own_ids, cand_ids])
    root = ids.copy()
    big = np.iinfo(np.int64).max
    changed = bool(hits)
    while changed:  # the smallest id spreads along links until nothing moves
        changed = False
        for q, c, linked in hits:
            a, b = root[q], root[len(own) + c]
            low_b = np.minimum(b, np.where(linked, a[:, None], big).min(axis=0))
            low_a = np.minimum(a, np.where(linked, low_b[None, :], big).min(axis=1))
            if (low_a < a).any() or (low_b < b).any():
                root[q], root[len(own) + c], changed = low_a, low_b, True
    moved = root != ids
    return total, ids[moved], root[moved]


def _cell_join(dim_at: int, cosine: float):
    schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        dim = key[dim_at].as_py()
        query = t.filter(t.column("role"))
        other = t.filter(pa.compute.invert(t.column("role")))
        if not len(query) or not len(other):
            return schema.empty_table()
        ids = query.column("cid").to_numpy()
        total, linked, root = joined(unit_rows(query.column("embedding"), dim), ids,
                                     unit_rows(other.column("embedding"), dim), other.column("cid").to_numpy(),
                                     other.column("copies").to_numpy(), cosine)
        return pa.table({"cid": np.concatenate([ids, linked]), "links": np.concatenate([total, np.zeros(len(linked), np.int64)]),
                         "root": np.concatenate([ids, root])}, schema=schema)

    import pyarrow.compute  # noqa: F401
    return run, "cid long, links long, root long"


def near_vectors(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship_package(spark)
    e = F.col("embedding")
    usable = (F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)
              & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
              & F.exists(e, lambda x: x != 0))
    rows = written(vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("embedding"),
        F.coalesce(usable, F.lit(False)).alias("usable")).withColumn(
            "cid", F.when(F.col("usable"), F.xxhash64("label", "embedding"))), "vectors")
    classes = written(rows.where("usable").groupBy("cid").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"))
        .withColumn("dim", F.size("embedding")), "vector-classes")

    n = classes.count()
    per = max(cell, n // MAX_PIVOTS + 1)
    sizes = classes.groupBy("label", "dim").count().where(F.col("count") > per)
    wanted = {(r[0], r[1]): math.ceil(r[2] / per) for r in sizes.collect()}  # at most n / per
    picked = {}
    if wanted:
        large = sizes.select(F.col("label").alias("l"), F.col("dim").alias("d"), F.ceil(F.col("count") / per).alias("k"))
        nth = Window.partitionBy("label", "dim").orderBy(F.xxhash64("cid"))
        first = (classes.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= MAX_PIVOTS + 1)
                 .join(F.broadcast(large), (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")))
                 .where(F.col("nth") <= F.col("k")).select("label", "dim", "embedding"))
        for r in first.collect():  # fewer than MAX_PIVOTS + one per large label
            picked.setdefault((r[0], r[1]), []).append(r[2])
    pivots = spark.sparkContext.broadcast(
        {k: unit_rows(pa.array(v, pa.list_(pa.float64())), k[1]) for k, v in picked.items()})
    fn, schema = _dealt(pivots, radius(cosine))
    dealt = written(classes.select("label", "dim", "cid", "copies", "embedding").mapInArrow(fn, schema), "vector-cells")
    place = ["label", "dim", "cell"]
    counts = dealt.groupBy(*place).agg(F.sum(F.col("own").cast("long")).alias("n_own"), F.count("*").alias("n_all"))
    counts = counts.select(*[F.col(c).alias(f"c_{c}") for c in place],
                           F.ceil(F.col("n_own") / block).cast("int").alias("n_i"), F.ceil(F.col("n_all") / block).cast("int").alias("n_j"))
    sized = dealt.join(counts, [F.col(c) == F.col(f"c_{c}") for c in place])
    spread = F.pmod(F.xxhash64("cid"), F.lit(1 << 30))
    i, j = (spread % F.greatest("n_i", F.lit(1))).cast("int"), (spread % F.col("n_j")).cast("int")
    keep = [*place, "cid", "copies", "embedding"]
    # own vectors meet every block of candidates, candidates every block of own vectors
    queries = sized.where("own").select(*keep, i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_j") - 1)).alias("j"),
                                        F.lit(True).alias("role"))
    others = sized.where("n_i > 0").select(*keep, F.explode(F.sequence(F.lit(0), F.col("n_i") - 1)).alias("i"), j.alias("j"),
                                           F.lit(False).alias("role"))
    fn, schema = _cell_join(1, cosine)
    found = written(queries.unionByName(others).groupBy(*place, "i", "j").applyInArrow(fn, schema), "vector-links")
    pivots.unpersist()

    links = found.groupBy("cid").agg(F.sum("links").alias("links")).withColumnRenamed("cid", "lc")
    comp = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")), "vector-components")
    comp = comp.select(F.col("id").alias("k"), "component")
    out = (rows.select("vec_id", "cid").join(links, F.col("cid") == F.col("lc"), "left")
           .join(comp, F.col("cid") == F.col("k"), "left")
           .select("vec_id", F.coalesce(F.col("links") - 1, F.lit(0)).alias("n_links"), F.coalesce("component", "cid").alias("comp")))
    least = out.where("comp is not null").groupBy(F.col("comp").alias("lk")).agg(F.min("vec_id").alias("least"))
    out = out.join(least, F.col("comp") == F.col("lk"), "left").withColumn("component_id", F.coalesce("least", "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
