"""A keyed table in hash buckets: upserts rewrite the buckets they touch only.

The table is a :mod:`versions` table whose parts are buckets of ``xxhash64(key)``. A merge
reads the buckets that its batch has keys of, combines them with the batch in one shuffle (by
bucket, which also places the write, so a bucket is one file) and publishes the new buckets
with one rename. Untouched buckets keep their files, and a key is looked up in one bucket.

Keys are unique, so the hash spreads them evenly, and a batch with many writes of one key has been
reduced to the last one before (:func:`eventide.operators.graph.latest_actors`). When buckets
outgrow ``bucket_bytes`` on average, the next merge deals the table into twice as many or more: the cost
of that rewrite is spread over the growth that caused it, as in any hash table.

A NULL key is a key. A key that stands in ``updates`` twice is an error of the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.session import checkpoint_root
from eventide.sources import versions as V

BUCKETS = 64
BUCKET_BYTES = 256 * 2**20
_PART = "__bucket"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def bucket_count(snapshot: V.Snapshot, default: int = BUCKETS) -> int:
    return int(snapshot.marks.get("buckets", default))


def wanted_buckets(snapshot: V.Snapshot, buckets: int, bucket_bytes: int) -> int:
    """The number of buckets for a table of this size: doubled until the average fits."""
    size = sum(p.bytes for p in snapshot.parts.values())
    while size > buckets * bucket_bytes:
        buckets *= 2
    return buckets


def merge(spark: SparkSession, root: str, updates: DataFrame, key: str, schema: str, overwrite: list[str],
          on_create: dict[str, Column], buckets: int = BUCKETS, bucket_bytes: int = BUCKET_BYTES) -> V.Snapshot:
    """MERGE ``updates(key, *overwrite)`` into the table under ``root``, which has ``schema``.

    A key not stored yet is created with the ``on_create`` values, a stored one gets every
    ``overwrite`` column (NULL included). ``updates`` is materialised once, by a reliable
    checkpoint, as both the list of touched buckets and the merge read it."""
    checkpoint_root(spark)
    base = V.current(spark, root)
    had = bucket_count(base, buckets)
    n = wanted_buckets(base, had, bucket_bytes)
    new = updates.select(key, *overwrite).withColumn(_PART, _bucket(F.col(key), n)).checkpoint(eager=True)
    touched = [str(r[0]) for r in new.select(_PART).distinct().collect()]  # a row per bucket at most
    if not touched:
        return base
    names = touched if n == had else None  # new bucket numbers: every row moves
    old = V.read(spark, root, base, schema, names)
    stored = F.struct(*overwrite)
    both = (old.withColumn(_PART, _bucket(F.col(key), n)).withColumn("__side", F.lit(0))
            .unionByName(new.withColumn("__side", F.lit(1)), allowMissingColumns=True))
    # one shuffle: the aggregate by (bucket, key) and the write by bucket both fit this placement
    wide = min(n, len(touched)) if n == had else n
    merged = (both.repartition(wide, _PART).groupBy(_PART, key)
              .agg(F.max_by(stored, "__side").alias("__new"),
                   *[F.first(F.when(F.col("__side") == 0, F.struct(c)), ignorenulls=True).alias(f"__{c}") for c in on_create]))
    columns = {key: F.col(key), **{c: F.col(f"__new.{c}") for c in overwrite},
               **{c: F.when(F.col(f"__{c}").isNull(), default).otherwise(F.col(f"__{c}.{c}")) for c, default in on_create.items()}}
    names_in_order = [f.name for f in old.schema.fields]
    parts = V.stage(merged.select(*[columns[c].alias(c) for c in names_in_order], _PART), root, _PART)
    gone = {} if n == had else {k: None for k in base.parts}
    return V.commit(spark, root, base, {**gone, **parts}, {"buckets": str(n)})


def table(spark: SparkSession, root: str, schema: str, key: str | None = None, keys: list | None = None,
          snapshot: V.Snapshot | None = None) -> DataFrame:
    """The table, or the rows of ``keys`` only, read from their buckets."""
    snap = V.current(spark, root) if snapshot is None else snapshot
    if keys is None:
        return V.read(spark, root, snap, schema)
    kind = spark.createDataFrame([], schema).schema[key].dataType
    wanted = spark.range(1).select(*[_bucket(F.lit(k).cast(kind), bucket_count(snap)).alias(f"k{i}") for i, k in enumerate(keys)]).first()
    rows = V.read(spark, root, snap, schema, sorted({str(b) for b in wanted}))
    return rows.filter(F.col(key).isin(*[k for k in keys if k is not None]) | (F.col(key).isNull() if None in keys else F.lit(False)))
