"""Sharding by longest-processing-time scheduling.

Groups that must stay together (equal texts) are sorted by size and go one after another to
the least-loaded shard, kept in a heap. Only a bounded list reaches the driver: groups above
``1/big_share`` of all bytes on their own (fewer than ``big_share`` can exist), and all others
summed into ``small_parts`` parts by the hash of their text. A part is far smaller than a
shard, so shard sizes differ by about one part unless a single group is larger than a shard.

Defined results: NULL text has size 1, crc 0 and shares the group of the empty text; equal rows
are rows of their own and stay together; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import empty_text, prefix_sums, written

SLOT_BUCKETS = 1024


def longest_first(sizes: list[tuple[int, int]], shards: int) -> list[int]:
    """The shard of each ``(key, size)``: largest first, always to the least-loaded shard."""
    loads = [(0, s) for s in range(shards)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i][1], sizes[i][0])):
        load, s = heapq.heappop(loads)
        out[i] = s
        heapq.heappush(loads, (load + sizes[i][1], s))
    return out


def shard(docs: DataFrame, shards: int = 16, big_share: int = 65536, small_parts: int = 16384) -> DataFrame:
    """One row per document of ``docs(doc_id, text)``: doc_id, size, text_crc32, shard, slot.

    ``slot`` numbers the rows of a shard from 0 without gaps (order: a hash bucket of the id,
    then the id)."""
    spark = docs.sparkSession
    text = empty_text(F.col("text"))
    rows = written(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")), "shard-rows")
    groups = written(rows.groupBy("h").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    is_big = F.col("bytes") * F.lit(big_share) > F.lit(total)
    part = F.pmod("h", F.lit(small_parts)).cast("long")
    big = [(r[0], r[1]) for r in groups.where(is_big).collect()]  # fewer than big_share
    small = [(r[0], r[1]) for r in groups.where(~is_big).groupBy(part.alias("p")).agg(F.sum("bytes")).collect()]
    placed = longest_first(big + small, shards)
    big_of = spark.createDataFrame([(k, s) for (k, _), s in zip(big, placed)], "big_h long, big_shard int")
    small_of = spark.createDataFrame([(k, s) for (k, _), s in zip(small, placed[len(big):])], "part long, part_shard int")
    # both lists are bounded by the parameters (under 2 MB), whatever the input
    rows = (rows.join(F.broadcast(big_of), F.col("h") == F.col("big_h"), "left")
            .join(F.broadcast(small_of), part == F.col("part"), "left")
            .withColumn("shard", F.coalesce("big_shard", "part_shard"))
            .select("doc_id", "size", "text_crc32", "shard").withColumn("one", F.lit(1).cast("long")))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_BUCKETS)).cast("int")
    return prefix_sums(rows, ["shard"], ["doc_id", "size", "text_crc32"], "one", "slot", bucket).select(
        "doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
