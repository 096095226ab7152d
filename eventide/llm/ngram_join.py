"""N-gram Jaccard join with several global token orders.

Documents are sets of distinct word shingles; two link when their Jaccard similarity reaches
``percent``. Under *any* global order of shingles, two linked sets share a shingle among the
first ``n - ceil(t n) + 1`` of each. The join uses three orders: postings are made from the
prefixes of the first (rare shingles first, by a count table of fixed size over all documents),
with size and position filters; a candidate must then also share prefix shingles under the
second order and under the third before its sets are intersected.

How it stays linear on large groups of copies:

* equal sets are one class; only classes are joined;
* round A compares each class only with one hub (the hub of a posting group is the class in
  which the shared shingle comes earliest, i.e. the one with the fewest rare shingles; of its
  groups' hubs a class takes the one it meets most often) and links are merged into components;
* round B compares, per posting group, the classes outside the hub's component with the group.
  Pairs inside one component need no comparison, as only components are asked for. Together the
  rounds lose no link: the first shared shingle of a linked pair puts both in one group, and
  either they are in one component already or one of them is outside the hub's.

Before any set is shipped, a pair must pass a bound on its symmetric difference: a class has a
bitmap of shingle parities, and as many shingles differ at least as bits do.

A shingle that the count table shows in very many documents has its group split by a salt for
round A. Shingles are compared by 64-bit hashes, classes by a 64-bit hash of their set and size.

Defined results: NULL, empty or blank text has an empty set and links with nothing; fewer words
than ``width`` make one shingle of the whole sequence; rows that repeat an id are separate rows;
a NULL id can be linked, and its component takes the smallest id that is not NULL; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, empty_text, released, ship_package, written

WIDTH = 5
PERCENT = 75
#: Slots of the shingle count table (bounded: 8 MB on the driver and in each worker).
COUNT_SLOTS = 1 << 20
#: Slots that one row of a task's counts holds.
COUNT_BLOCK = 4096
#: A posting group expected to have more documents than this is split.
HOT_GROUP = 20_000
#: Slots of the filter that names the documents whose sets are needed (bounded: 16 MB).
NEEDED_SLOTS = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MASK = (1 << 64) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hash by word; emptied when it has grown to ``limit`` words."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        import xxhash
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _scrambled(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed * 0x632BE59BD9B4E019 & _MASK)) * _MIX
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(hashes) > _Hashes.limit:
        hashes.clear()
    k = min(width, len(words))
    with np.errstate(over="ignore"):
        s = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            s = (s ^ (s >> np.uint64(31))) * _MIX + h[i:len(h) - k + 1 + i]
    return np.unique(_scrambled(s, 1))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())


def _class_of(s: np.ndarray) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def prefix_length(n, percent: int = PERCENT):
    """Shingles of a set of ``n`` among which every linked set must share one."""
    return n - (n * percent + 99) // 100 + 1


def prefix_length_of(n: str, percent: int) -> Column:
    return (F.col(n) - F.floor((F.col(n) * percent + 99) / 100) + 1).cast("int")


def _rows(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def parity_bits(s: np.ndarray) -> list[int]:
    """Parity of the number of shingles per bit, as 64-bit words: a power of two of them, with at
    least two bits a shingle. Halving the words and combining them by exclusive or gives the
    bitmap of the next smaller length."""
    bits = 64
    while bits < 2 * len(s):
        bits *= 2
    odd = np.bincount((_scrambled(s, 5) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _count_shingles(width: int, slots: int):
    """Per document id, set size, class and parities; per task a count of shingles by slot."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("bits", pa.list_(pa.int64())),
                        ("block", pa.int32()), ("hits", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = _Hashes(), np.zeros(slots, np.int64)
        for b in batches:
            ids, sizes, cids, bits, at = [], [], [], [], [np.empty(0, np.int64)]
            for i, t in _texts([b]):
                s = shingle_hashes(t, width, hashes)
                ids.append(i)
                sizes.append(len(s))
                cids.append(_class_of(s) if len(s) else None)
                bits.append(parity_bits(s) if len(s) else None)
                at.append((s % np.uint64(slots)).astype(np.int64))
            counts += np.bincount(np.concatenate(at), minlength=slots)
            none = [None] * len(ids)
            yield _rows(schema, ids, sizes, cids, bits, none, none)
        blocks = [(i, x.tolist()) for i, x in enumerate(counts.reshape(-1, COUNT_BLOCK)) if x.any()]
        for k in range(0, len(blocks), 32):
            part = blocks[k:k + 32]
            none = [None] * len(part)
            yield _rows(schema, none, none, none, none, [i for i, _ in part], [x for _, x in part])

    return run, "doc_id long, n long, cid long, bits array<long>, block int, hits array<long>"


def _by_order(s: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    """A set in the global order (times counted, scrambled hash)."""
    c = counts[(s % np.uint64(len(counts))).astype(np.int64)]
    return s[np.lexsort((_scrambled(s, seed), c))]


def _postings(width: int, percent: int, counts):
    schema = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("hot", pa.bool_()),
                        ("pos", pa.int32()), ("n", pa.int32()), ("cid", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = _Hashes(), counts.value
        for b in batches:
            toks, pos, ns, cids = [], [], [], []
            for _, t in _texts([b]):
                s = shingle_hashes(t, width, hashes)
                if not len(s):
                    continue
                p = prefix_length(len(s), percent)
                toks.append(_by_order(s, table, 2)[:p])
                pos.append(np.arange(p, dtype=np.int32))
                ns.append(np.full(p, len(s), np.int32))
                cids.append(np.full(p, _class_of(s), np.int64))
            if toks:
                tok, cid = np.concatenate(toks), np.concatenate(cids)
                parts = table[(tok % np.uint64(len(table))).astype(np.int64)] // HOT_GROUP + 1
                salt = ((cid >> 7) % parts).astype(np.int32)
                yield _rows(schema, tok.view(np.int64), salt, parts > 1,
                            np.concatenate(pos), np.concatenate(ns), cid)

    return run, "token long, salt int, hot boolean, pos int, n int, cid long"


def _sets(width: int):
    """Class and set, in the second order (a scrambled hash, ascending)."""
    schema = pa.schema([("doc_id", pa.int64()), ("cid", pa.int64()), ("n", pa.int32()),
                        ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            ids, cids, sets = [], [], []
            for i, t in _texts([b]):
                s = shingle_hashes(t, width, hashes)
                if len(s):
                    ids.append(i)
                    cids.append(_class_of(s))
                    sets.append(s[np.argsort(_scrambled(s, 3), kind="stable")].view(np.int64))
            if ids:
                ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(cids, pa.int64()),
                     pa.array(np.diff(ends), pa.int32()), lists], schema=schema)

    return run, "doc_id long, cid long, n int, tokens array<long>"


def _can_link(percent: int, n1: str, p1: str, n2: str, p2: str) -> Column:
    """Size and position filters for a shingle at ``p1`` of ``n1`` and at ``p2`` of ``n2``."""
    n1, p1, n2, p2 = (F.col(c).cast("long") for c in (n1, p1, n2, p2))
    most = F.least(n1 - p1, n2 - p2)
    return ((F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent)
            & (most * (100 + percent) >= (n1 + n2) * percent))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _parities_allow(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` whose parities do not differ in more bits than a link allows."""
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"w{c}"))

    def folded(x: Column, size: Column) -> Column:
        low, high = F.slice(x, F.lit(1), size), F.slice(x, size + 1, size)
        return F.when(F.size(x) > size, F.zip_with(low, high, lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    a, b = F.col("wa"), F.col("wb")
    size = F.least(F.size(a), F.size(b))  # linked sets differ in size so little that one fold is enough
    differ = F.aggregate(F.zip_with(folded(a, size), folded(b, size), lambda p, q: F.bit_count(p.bitwiseXOR(q))),
                         F.lit(0), lambda x, y: x + y)
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
            .where(differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b"))


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` of classes that link.

    Sets are made again for the classes in ``pairs`` only: a filter of bounded size lets their
    documents through before any shingling, an exact join keeps one document per class."""
    ends = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    needed = classes.join(ends, F.col("cid") == F.col("c"), "left_semi").select(
        F.col("cid").alias("c"), F.col("rep"))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(NEEDED_SLOTS)).cast("int")
    slots = needed.select(slot("rep").alias("slot")).distinct()
    fn, schema = _sets(width)
    some = (docs.withColumn("slot", slot("doc_id")).join(F.broadcast(slots), "slot", "left_semi")
            .select("doc_id", "text").mapInArrow(fn, schema))
    # rows that repeat a representative's id and text give a link more than once, no other one
    sets = (some.join(needed, F.col("cid") == F.col("c")).where(F.col("doc_id").eqNullSafe(F.col("rep")))
            .select("cid", "n", "tokens"))
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    first = lambda t, n: F.slice(t, F.lit(1), prefix_length_of(n, percent))
    last = lambda t, n: F.slice(t, -prefix_length_of(n, percent), prefix_length_of(n, percent))
    same = F.size(F.array_intersect("ta", "tb"))
    return (pairs.join(left, "a").join(right, "b")
            # the second order, then the third (the second backwards), then the sets themselves
            .where(F.arrays_overlap(first("ta", "na"), first("tb", "nb")))
            .where(F.arrays_overlap(last("ta", "na"), last("tb", "nb")))
            .where(same * 100 >= (F.col("na") + F.col("nb") - same) * percent)
            .select("a", "b").distinct())


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document of ``docs(doc_id, text)``: doc_id, n_shingles and component_id, the
    smallest id reachable by links."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text(F.col("text")).alias("text"))
    fn, schema = _count_shingles(width, COUNT_SLOTS)
    counted = written(docs.mapInArrow(fn, schema), "ngram-counts")
    rows = counted.where("block is null").select("doc_id", "n", "cid")
    classes = written(counted.where("n > 0").groupBy("cid").agg(
        F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits")), "ngram-classes")
    hits = (counted.where("block is not null").select("block", F.posexplode("hits").alias("i", "hits")).where("hits > 0")
            .groupBy((F.col("block") * COUNT_BLOCK + F.col("i")).alias("slot")).agg(F.sum("hits").alias("hits")).toArrow())
    table = np.zeros(COUNT_SLOTS, np.int64)  # one number per slot, whatever the input
    table[hits.column("slot").to_numpy()] = hits.column("hits").to_numpy()
    counts = spark.sparkContext.broadcast(table)

    from pyspark.sql import Window
    fn, schema = _postings(width, percent, counts)
    group = Window.partitionBy("token", "salt")
    posts = written(
        docs.mapInArrow(fn, schema)
        .withColumn("lo", F.min("cid").over(group)).withColumn("hi", F.max("cid").over(group))
        .withColumn("hub", F.min(F.struct("pos", "n", "cid")).over(group))
        .where("hot or lo <> hi").select("token", "pos", "n", "cid", "hub"), "ngram-postings")

    # round A: every class against the hub of its groups, hubs of split groups among themselves
    tops = posts.groupBy("token").agg(F.min("hub").alias("top"))
    spokes = posts.select("n", "pos", "cid", F.col("hub.n").alias("n2"), F.col("hub.pos").alias("p2"), F.col("hub.cid").alias("c2"))
    hubs = (posts.select("token", "hub").distinct().join(tops, "token")
            .select("hub.n", "hub.pos", "hub.cid", F.col("top.n").alias("n2"), F.col("top.pos").alias("p2"), F.col("top.cid").alias("c2")))
    met = (spokes.where("cid <> c2").where(_can_link(percent, "n", "pos", "n2", "p2"))
           .groupBy("cid", "c2").count().groupBy("cid").agg(F.max_by("c2", F.struct("count", "c2")).alias("c2")))
    first = met.unionByName(hubs.where("cid <> c2").where(_can_link(percent, "n", "pos", "n2", "p2")).select("cid", "c2"))
    first = written(_parities_allow(first.select(*_pair("cid", "c2")).distinct(), classes, percent), "ngram-pairs")
    released(first.sparkSession)
    links = written(_verified(docs, classes, first, width, percent), "ngram-links")
    released(links.sparkSession)
    comp = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "ngram-components")
    released(links.sparkSession)

    # round B: per group, what is outside the component of the hub against the group
    of = comp.select(F.col("id").alias("k"), F.col("component").alias("comp"))
    known = (posts.select("token", "pos", "n", "cid").distinct().join(of, F.col("cid") == F.col("k"), "left")
             .select("token", "pos", "n", "cid", F.coalesce("comp", "cid").alias("comp")))
    top = (tops.select("token", F.col("top.cid").alias("t")).join(of, F.col("t") == F.col("k"), "left")
           .select(F.col("token").alias("tt"), F.coalesce("comp", "t").alias("tcomp")))
    outside = (known.join(top, F.col("token") == F.col("tt")).where("comp <> tcomp")
               .select(F.col("token").alias("ot"), F.col("pos").alias("p2"), F.col("n").alias("n2"),
                       F.col("cid").alias("c2"), F.col("comp").alias("comp2")))
    second = (outside.join(known, (F.col("ot") == F.col("token")) & (F.col("comp") != F.col("comp2"))
                           & _can_link(percent, "n", "pos", "n2", "p2"))
              .select(*_pair("cid", "c2")).distinct().join(first, ["a", "b"], "left_anti"))
    second = written(_parities_allow(second, classes, percent), "ngram-pairs")
    released(links.sparkSession)
    more = written(_verified(docs, classes, second, width, percent), "ngram-links")
    released(links.sparkSession)
    if more.head(1):
        comp = components(comp.where("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v"))
                          .unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v"))), "ngram-components")
    counts.unpersist()
    of = comp.select(F.col("id").alias("k"), F.col("component").alias("comp"))
    rows = (rows.join(of, F.col("cid") == F.col("k"), "left")
            .select("doc_id", "n", F.coalesce("comp", "cid").alias("comp")))
    least = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    least = least.withColumnRenamed("comp", "lk")
    return rows.join(least, F.col("comp") == F.col("lk"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document per component, the one of the smallest id; all columns stay.

    Rows are told apart by a key of id and text, so rows without id are compared like all others, and
    rows that share an id are joined only where their texts link. An id comes before none, and of
    rows that are equal in id and text one stays. Texts without words link with nothing and stay. Only
    rows that the bounded filter of keys to look at lets through are shuffled, the others pass as they are."""
    text = empty_text(F.col("text"))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("no id"), text)).otherwise(F.xxhash64(F.col("doc_id").cast("long"), text))
    out = written(near_duplicates(docs.select(key.alias("doc_id"), "text"), width, percent).where("n_shingles > 0"), "ngram-classes")
    ids = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("id")).distinct()
    of = written(out.select("doc_id", "component_id").distinct().join(ids, F.col("doc_id") == F.col("key"))
                 .select("key", "component_id", F.struct(F.col("id").isNull().alias("none"), "id", "key").alias("place")), "ngram-places")
    first = of.groupBy(F.col("component_id").alias("c")).agg(F.min("place").alias("first"))
    gone = of.join(first, F.col("component_id") == F.col("c")).where(F.col("key") != F.col("first.key")).select(F.col("key").alias("gone"))
    gone = written(gone, "ngram-gone")
    again = out.groupBy(F.col("doc_id").alias("gone")).count().where("count > 1").select("gone")
    slot = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(NEEDED_SLOTS)).cast("int")
    slots = gone.unionByName(again).select(slot("gone").alias("slot")).distinct()
    rows = docs.select(key.alias("key"), F.struct(*docs.columns).alias("row")).withColumn("slot", slot("key"))
    free = rows.join(F.broadcast(slots), "slot", "left_anti").select("row")
    held = (rows.join(F.broadcast(slots), "slot", "left_semi").select("key", "row")
            .join(gone, F.col("key") == F.col("gone"), "left_anti"))
    # of rows equal in id and text one, picked by a partial aggregate, so that many of them are no hot group
    twice = held.join(again.withColumnRenamed("gone", "twice"), F.col("key") == F.col("twice"), "left")
    one = twice.where("twice is not null").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    held = twice.where("twice is null").select("row").unionByName(one)
    return free.unionByName(held).select("row.*")
