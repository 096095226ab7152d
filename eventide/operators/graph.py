"""The event graph as tables: actors, event nodes, interaction and impact edges.

Nodes and edges are plain DataFrames; every graph pattern of the reference is a one-hop
equi-join or a group-by over the edge table (J4, J5, A12-A14, W1, O1, O2, U3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.text import EVENT_NODE_TYPE, UNKNOWN_TYPE, event_description
from eventide.operators.events import accepted_rows
from eventide.sources import bucketed

ACTOR_SCHEMA = "name string, code string, type string"
EVENT_NODE_SCHEMA = "event_id string, type string, date string, description string"
INTERACTION_SCHEMA = ("event_id string, src string, dst string, event_code string, root_code string, "
                      "quad_class string, goldstein_scale string, avg_tone string, date string")
IMPACT_SCHEMA = "event_id string, actor string"


def interaction_edges(rows: DataFrame) -> DataFrame:
    """One directed ``INTERACTED_WITH`` edge per accepted row, actor1 → actor2 (an
    ``event_id`` and a linked ``ticker`` are carried along when the rows have them)."""
    cols = [F.col("actor1_name").alias("src"), F.col("actor2_name").alias("dst"), "event_code",
            F.col("event_root_code").alias("root_code"), "quad_class", "goldstein_scale", "avg_tone",
            F.col("sqldate").alias("date")]
    if "event_id" in rows.columns:
        cols.insert(0, "event_id")
    if "ticker" in rows.columns:
        cols.append("ticker")
    return accepted_rows(rows).select(*cols)


def event_nodes(rows: DataFrame) -> DataFrame:
    """One event node per accepted row (F8)."""
    cols = [F.lit(EVENT_NODE_TYPE).alias("type"), F.col("sqldate").alias("date"),
            event_description("event_code", "actor1_name", "actor2_name").alias("description")]
    if "event_id" in rows.columns:
        cols.insert(0, "event_id")
    return accepted_rows(rows).select(*cols)


def impact_edges(rows: DataFrame) -> DataFrame:
    """Two ``IMPACTS`` edges per accepted row, event → actor1 and event → actor2."""
    return accepted_rows(rows).select(
        "event_id", F.explode(F.array("actor1_name", "actor2_name")).alias("actor"))


def actor_sides(rows: DataFrame, order_col: str, *more: str) -> DataFrame:
    """Both actor sides of each row as ``(name, code, ord)``; actor1 is written before actor2."""
    a1 = rows.select(F.col("actor1_name").alias("name"), F.col("actor1_code").alias("code"),
                     F.struct(F.col(order_col).alias("k"), F.lit(1).alias("side")).alias("ord"), *more)
    a2 = rows.select(F.col("actor2_name").alias("name"), F.col("actor2_code").alias("code"),
                     F.struct(F.col(order_col).alias("k"), F.lit(2).alias("side")).alias("ord"), *more)
    return a1.unionByName(a2)


def latest_actors(rows: DataFrame, order_col: str, lead: str | None = None) -> DataFrame:
    """Last write wins per actor name, a NULL code included.

    ``max_by`` is a partial aggregate, so a hot actor is combined map-side. The order
    struct is kept so later batches can be merged (J5). Strings and structs are aggregated by
    sorting the rows; ``lead`` names a time or number column by which ``order_col`` orders first in
    ``rows`` (NULL smallest), so that only each name's rows at its largest value are sorted.
    """
    sides = actor_sides(rows, order_col, *([lead] if lead else []))
    if lead:
        last = sides.groupBy(F.col("name").alias("__n")).agg(F.max(lead).alias("__last"))
        sides = sides.join(last, F.col("name").eqNullSafe(F.col("__n")) & F.col(lead).eqNullSafe(F.col("__last")))
    return (sides.groupBy("name")
            .agg(F.max_by("code", "ord").alias("code"), F.max("ord").alias("ord")))


def actor_nodes(rows: DataFrame, order_col: str) -> DataFrame:
    """Actor node table ``(name, code, type)`` from accepted rows (see
    :func:`eventide.operators.events.accepted_rows`) in write order."""
    return latest_actors(rows, order_col).select(
        "name", "code", F.lit(UNKNOWN_TYPE).alias("type"))


def upsert_by_key(existing: DataFrame, updates: DataFrame, key: str, overwrite: list[str],
                  on_create: dict[str, Column]) -> DataFrame:
    """MERGE semantics (J5): keys absent from ``existing`` are created with ``on_create``
    defaults; matched keys get every ``overwrite`` column from ``updates`` (NULL included).

    ``updates`` must hold at most one row per key (see :func:`latest_actors`).
    """
    e = existing.alias("e")
    u = updates.withColumn("__hit", F.lit(True)).alias("u")
    j = e.join(u, F.col(f"e.{key}") == F.col(f"u.{key}"), "full_outer")
    hit = F.col("u.__hit").isNotNull()
    cols = [F.coalesce(F.col(f"u.{key}"), F.col(f"e.{key}")).alias(key)]
    for c in overwrite:
        cols.append(F.when(hit, F.col(f"u.{c}")).otherwise(F.col(f"e.{c}")).alias(c))
    for c, default in on_create.items():
        cols.append(F.coalesce(F.col(f"e.{c}"), default).alias(c))
    return j.select(*cols)


def merge_actor_batch(actors: DataFrame, batch_rows: DataFrame, order_col: str) -> DataFrame:
    """Apply one batch of accepted rows to an actor table ``(name, code, type)``."""
    latest = latest_actors(batch_rows, order_col).select("name", "code")
    return upsert_by_key(actors, latest, "name", ["code"], {"type": F.lit(UNKNOWN_TYPE)})


def merge_stored_actors(spark, root: str, batch_rows: DataFrame, order_col: str, **options):
    """:func:`merge_actor_batch` into a bucketed actor table under ``root``: only the buckets that the
    batch names actors of are read and written (see :mod:`eventide.sources.bucketed`)."""
    latest = latest_actors(batch_rows, order_col).select("name", "code")
    return bucketed.merge(spark, root, latest, "name", ACTOR_SCHEMA, ["code"], {"type": F.lit(UNKNOWN_TYPE)}, **options)


def stored_actors(spark, root: str, names: list[str] | None = None) -> DataFrame:
    """The bucketed actor table, or the rows of some names from their buckets alone."""
    return bucketed.table(spark, root, ACTOR_SCHEMA, "name", names)


def graph_counts(actors: DataFrame, events: DataFrame, interactions: DataFrame,
                 impacts: DataFrame, extra_nodes: list[DataFrame] | None = None) -> DataFrame:
    """Node and relationship counts (A13) as one row; each count is a partial aggregate."""
    def tagged(df: DataFrame, kind: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))

    parts = [tagged(actors, "node"), tagged(events, "node")]
    parts += [tagged(n, "node") for n in (extra_nodes or [])]
    parts += [tagged(interactions, "rel"), tagged(impacts, "rel")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(
        F.sum(F.when(F.col("kind") == "node", F.col("n"))).cast("bigint").alias("node_count"),
        F.sum(F.when(F.col("kind") == "rel", F.col("n"))).cast("bigint").alias("rel_count"))


def graph_counts_from_rows(rows: DataFrame) -> DataFrame:
    """:func:`graph_counts` of the graph that accepted ``rows`` build, in one pass.

    Each accepted row adds one event node, one interaction and two impacts, and names two
    actor sides; so one group-by over the exploded actor names (a partial aggregate)
    yields both the distinct actors and the row count.
    """
    per_actor = (rows.select(F.explode(F.array("actor1_name", "actor2_name")).alias("name"))
                 .groupBy("name").agg(F.count(F.lit(1)).alias("sides")))
    t = per_actor.agg(F.count(F.lit(1)).alias("actors"), F.sum("sides").alias("sides"))
    n_rows = F.col("sides") / 2
    return t.select((F.col("actors") + n_rows).cast("bigint").alias("node_count"),
                    (n_rows * 3).cast("bigint").alias("rel_count"))


def top_actors(interactions: DataFrame, k: int = 5) -> DataFrame:
    """Actors by out-degree, top ``k`` (A14, O2); ties broken by name."""
    return (interactions.groupBy(F.col("src").alias("actor"))
            .agg(F.count(F.lit(1)).alias("relationship_count"))
            .orderBy(F.col("relationship_count").desc(), F.col("actor").asc())
            .limit(k))


def _recent_order() -> list[Column]:
    return [F.col("date").desc_nulls_first(), F.col("dst").asc(), F.col("event_code").asc()]


def recent_interactions(interactions: DataFrame, actor: str, k: int = 15) -> DataFrame:
    """The ``k`` most recent outgoing interactions of one actor (J4, O1); a NULL date sorts
    first, as the graph store does for descending order."""
    return (interactions.filter(F.col("src") == actor)
            .orderBy(*_recent_order())
            .limit(k)
            .select(F.col("dst").alias("neighbor"), "event_code", "date"))


def recent_interactions_all(interactions: DataFrame, k: int = 15) -> DataFrame:
    """:func:`recent_interactions` for every actor at once.

    A count per actor and date (a hash aggregate) tells the date at which an actor's newest dates hold
    ``k`` rows; only rows from then on, or without a date, are ranked, so the sort does not meet
    the others. ``row_number() <= k`` lets Spark insert a partial per-group limit before the shuffle
    (``WindowGroupLimit``), so a hot actor sends at most ``k`` rows per map task.
    """
    w = Window.partitionBy("src").orderBy(*_recent_order())
    newer = Window.partitionBy("src").orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    floors = (interactions.filter(F.col("date").isNotNull()).groupBy("src", "date").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("held", F.sum("n").over(newer)).filter(F.col("held") >= k)
              .groupBy(F.col("src").alias("__src")).agg(F.max("date").alias("__floor")))
    rows = interactions.select("src", "dst", "event_code", "date")
    rows = (rows.join(floors, F.col("src").eqNullSafe(F.col("__src")), "left")
            .filter(F.col("__floor").isNull() | F.col("date").isNull() | (F.col("date") >= F.col("__floor"))))
    return (rows.select("src", "dst", "event_code", "date")
            .withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k)
            .select(F.col("src").alias("actor"), F.col("rank").cast("bigint").alias("rank"),
                    F.col("dst").alias("neighbor"), "event_code", "date"))


def empty_graph(spark) -> dict[str, DataFrame]:
    """The five graph tables with their schemas and no rows (S15 reset)."""
    return {
        "actors": spark.createDataFrame([], ACTOR_SCHEMA),
        "countries": spark.createDataFrame([], "name string, iso_code string, capital string, uri string, "
                                               "type string, region string"),
        "event_nodes": spark.createDataFrame([], EVENT_NODE_SCHEMA),
        "interactions": spark.createDataFrame([], INTERACTION_SCHEMA),
        "impacts": spark.createDataFrame([], IMPACT_SCHEMA),
    }


def dangling_edges(interactions: DataFrame, actors: DataFrame) -> DataFrame:
    """Interaction edges whose source or target is not an actor node; empty for a graph
    built by this module, since edges and actors come from the same accepted rows (J4)."""
    names = actors.select(F.col("name"))
    missing_src = interactions.join(names, interactions.src == names.name, "left_anti")
    missing_dst = interactions.join(names, interactions.dst == names.name, "left_anti")
    return missing_src.unionByName(missing_dst)


def reset_graph(spark, root: str) -> None:
    """Empty the graph under ``root`` (S15): whatever a batch or stream ingest has written there,
    actor deltas and snapshots included, goes, and every table is there again without rows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for name, df in empty_graph(spark).items():
        df.write.parquet(f"{root}/{name}")
