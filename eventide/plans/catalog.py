"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (through the ``v_*`` projections) or data Spark
derives from them, over whole tables. Doubles are rounded to ``params.ROUND`` places
in the output so the oracle comparison is stable across summation orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from eventide.functions.timefmt import day_start, ntz
from eventide.operators import baseline as B
from eventide.operators import briefing as BR
from eventide.operators import conflict as C
from eventide.operators import coverage as CV
from eventide.operators import detect as D
from eventide.operators import fusion as FU
from eventide.operators import graph as G
from eventide.operators import incremental as INC
from eventide.operators import mentions as M
from eventide.operators import term_index as TI
from eventide.operators import triples as T
from eventide.operators.events import accepted_rows, stamp_intervals, valid_events
from eventide.plans import params as P
from eventide.plans.views import (EVENT_COLUMNS, table, v_actor_updates, v_interactions,
                                  v_interval_events, v_prices, v_triples)
from eventide.session import path_exists, scratch_path
from eventide.sources import articles as AR
from eventide.sources import backfill as BF
from eventide.sources import edge_store as ES
from eventide.sources import export as EX
from eventide.sources import interval_log as IL
from eventide.sources import model_state as MS
from eventide.sources import prices as PR
from eventide.sources import resumable as RS
from eventide.sources import samples as SA
from eventide.sources import sparql as SP
from eventide.sources import versions as V
from eventide.streaming import archives as ZS
from eventide.streaming import detect as SD
from eventide.streaming import ingest as SI
from eventide.streaming import quarantine as QU
from eventide.streaming import stateful as SF
from eventide.streaming import stats as SS

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, places: int = P.ROUND) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), places).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


# ---------------------------------------------------------------------------
# shared inputs
# ---------------------------------------------------------------------------

_LANDED: dict[tuple[str, str], str] = {}


def _landed(spark: SparkSession, key: tuple[str, str]) -> bool:
    """Whether a landed table is there (scratch folders may have been removed since)."""
    return key in _LANDED and path_exists(spark, _LANDED[key])


def interactions(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The event rows, landed once per application and input as a Parquet log in the shared
    scratch folder: the five joins behind them run once, and every query reads its columns
    of the log. ``more`` may name ``event_id`` and ``ticker``."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if not _landed(spark, key):
        path = scratch_path(spark, "interactions")
        v_interactions(spark, sf_dir, with_id=True, with_ticker=True).write.parquet(path)
        _LANDED[key] = path
    return spark.read.parquet(_LANDED[key]).select(*EVENT_COLUMNS, *more)


def clean_interactions(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return valid_events(interactions(spark, sf_dir, *more), text_cols=EVENT_COLUMNS)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.interaction_edges(clean_interactions(spark, sf_dir))


# ---------------------------------------------------------------------------
# projections / filters
# ---------------------------------------------------------------------------

@register("valid_events")
def q_valid_events(spark, sf_dir):
    return clean_interactions(spark, sf_dir)


# ---------------------------------------------------------------------------
# graph
# ---------------------------------------------------------------------------

@register("event_nodes")
def q_event_nodes(spark, sf_dir):
    return G.event_nodes(clean_interactions(spark, sf_dir))


@register("interaction_edges")
def q_interaction_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@register("impact_edges")
def q_impact_edges(spark, sf_dir):
    """Every impact edge with its event, named by the line item the event comes from."""
    imp = G.impact_edges(clean_interactions(spark, sf_dir, "event_id"))
    row = F.regexp_extract("event_id", r":(\d+)$", 1).cast("bigint")
    return imp.select(row.alias("event_row"), "actor")


@register("graph_counts")
def q_graph_counts(spark, sf_dir):
    return G.graph_counts_from_rows(accepted_rows(clean_interactions(spark, sf_dir)))


@register("actor_nodes")
def q_actor_nodes(spark, sf_dir):
    return G.actor_nodes(v_actor_updates(spark, sf_dir), "order_key")


@register("actor_upsert_two_batches")
def q_actor_upsert_two_batches(spark, sf_dir):
    rows = v_actor_updates(spark, sf_dir)
    cut = F.expr("TIMESTAMP_NTZ'2024-01-15 00:00:00'")
    first, second = rows.filter(F.col("ts") < cut), rows.filter(F.col("ts") >= cut)
    actors = G.empty_graph(spark)["actors"]
    actors = G.merge_actor_batch(actors, first, "order_key")
    return G.merge_actor_batch(actors, second, "order_key")


@register("actor_upsert_bucketed")
def q_actor_upsert_bucketed(spark, sf_dir):
    """A batch per week of the month, merged in time order into a bucketed actor table."""
    root = scratch_path(spark, "actors")
    rows = v_actor_updates(spark, sf_dir)
    for first in range(1, 32, 8):
        week = F.dayofmonth("ts").between(first, first + 7)
        G.merge_stored_actors(spark, root, rows.filter(week), "order_key", buckets=16)
    return G.stored_actors(spark, root)


@register("top_actors")
def q_top_actors(spark, sf_dir):
    return G.top_actors(edges(spark, sf_dir), P.TOP_K)


@register("actor_recent_interactions")
def q_actor_recent_interactions(spark, sf_dir):
    return G.recent_interactions(edges(spark, sf_dir), P.ACTOR, P.RECENT_K)


@register("actor_recent_interactions_clustered")
def q_actor_recent_interactions_clustered(spark, sf_dir):
    """The same from the stored edge table: four batches, compacted, then one actor's files alone."""
    root = scratch_path(spark, "edges")
    rows = G.interaction_edges(clean_interactions(spark, sf_dir, "event_id"))
    for batch in range(4):
        ES.add_batch(spark, root, rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == batch), batch)
    ES.compact(spark, root)
    return ES.recent(spark, root, P.ACTOR, P.RECENT_K)


@register("actor_recent_interactions_all")
def q_actor_recent_interactions_all(spark, sf_dir):
    return G.recent_interactions_all(edges(spark, sf_dir), P.RECENT_K)


# ---------------------------------------------------------------------------
# actor-pair conflicts
# ---------------------------------------------------------------------------

@register("conflict_daily_counts")
def q_conflict_daily_counts(spark, sf_dir):
    return C.daily_conflict_counts(C.conflict_edges(edges(spark, sf_dir)))


@register("conflict_baseline")
def q_conflict_baseline(spark, sf_dir):
    conf = C.conflict_edges(edges(spark, sf_dir), *P.PAIR)
    return rounded(C.conflict_baseline(C.daily_conflict_counts(conf)))


@register("conflict_baseline_by_code")
def q_conflict_baseline_by_code(spark, sf_dir):
    conf = C.conflict_edges(edges(spark, sf_dir), *P.PAIR, event_root_code=P.PAIR_CODE)
    return rounded(C.conflict_baseline(C.daily_conflict_counts(conf)))


@register("conflict_recent_count")
def q_conflict_recent_count(spark, sf_dir):
    conf = C.conflict_edges(edges(spark, sf_dir), *P.PAIR, until=P.AS_OF)
    return C.recent_conflict_count(conf, P.AS_OF, P.PAIR_RECENT_DAYS)


@register("conflict_anomaly")
def q_conflict_anomaly(spark, sf_dir):
    return rounded(C.conflict_anomaly(edges(spark, sf_dir), P.AS_OF, P.DAYS, P.THRESHOLD,
                                      actor1=P.PAIR[0], actor2=P.PAIR[1], until=P.AS_OF))


@register("conflict_anomaly_all_pairs")
def q_conflict_anomaly_all_pairs(spark, sf_dir):
    return rounded(C.conflict_anomaly(edges(spark, sf_dir), P.AS_OF, P.DAYS, P.THRESHOLD, until=P.AS_OF))


# ---------------------------------------------------------------------------
# interval log: stamping, counts, baseline, model, detection, coverage
# ---------------------------------------------------------------------------

def interval_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_events(v_interval_events(spark, sf_dir), text_cols=P.METRIC_COLUMNS)


def _counts(spark, sf_dir):
    return B.interval_counts(interval_events(spark, sf_dir), P.METRIC_COLUMNS)


def _model(spark, sf_dir, dense=False):
    counts = _counts(spark, sf_dir)
    if dense:
        return B.baseline_dense(counts, B.significant_types(counts, P.MIN_TOTAL), P.BASELINE_START, P.BASELINE_END)
    return B.sparse_model(counts, P.MIN_TOTAL, P.BASELINE_START, P.BASELINE_END)


@register("interval_stamp")
def q_interval_stamp(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "ts")
    return stamp_intervals(ev, "ts").select("event_id", "interval_ts", "interval_key", "interval_timestamp")


@register("interval_counts")
def q_interval_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@register("interval_counts_grouping_sets")
def q_interval_counts_grouping_sets(spark, sf_dir):
    return B.interval_counts_grouping_sets(interval_events(spark, sf_dir), P.METRIC_COLUMNS)


@register("significant_types")
def q_significant_types(spark, sf_dir):
    return B.significant_types(_counts(spark, sf_dir), P.MIN_TOTAL)


@register("event_baseline_dense")
def q_event_baseline_dense(spark, sf_dir):
    return rounded(_model(spark, sf_dir, dense=True))


@register("event_baseline_sparse")
def q_event_baseline_sparse(spark, sf_dir):
    return rounded(_model(spark, sf_dir))


@register("model_state_json")
def q_model_state_json(spark, sf_dir):
    """Model → JSON lines text → parsed back (the text itself differs between engines)."""
    return rounded(MS.parse_model_json(MS.model_json_lines(_model(spark, sf_dir))))


@register("model_state_roundtrip")
def q_model_state_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "model_state")
    MS.write_model_state(_model(spark, sf_dir), path)
    return rounded(MS.read_model_state(spark, path))


@register("baseline_incremental")
def q_baseline_incremental(spark, sf_dir):
    """Models from daily partial sums: two ranges, then the first again after one day was landed anew."""
    log, root = scratch_path(spark, "interval_log"), scratch_path(spark, "partials")
    rows = _full_event_columns(interval_events(spark, sf_dir))
    IL.write_interval_log(rows, log, fmt="parquet")
    INC.refresh(spark, root, IL.read_interval_log(spark, log, fmt="parquet"), P.METRIC_COLUMNS)
    runs = {"month": INC.model(spark, root, P.MIN_TOTAL, P.BASELINE_START, P.BASELINE_END),
            "cut": INC.model(spark, root, P.MIN_TOTAL, P.CUT_START, P.CUT_END)}
    again = INC.rows_of_days(rows, [P.RESTATED_DAY])
    IL.write_interval_log(again.filter(F.coalesce("quad_class", F.lit("")) != P.RESTATED_WITHOUT), log, fmt="parquet")
    INC.refresh(spark, root, IL.read_interval_log(spark, log, fmt="parquet"), P.METRIC_COLUMNS, [P.RESTATED_DAY])
    runs["restated"] = INC.model(spark, root, P.MIN_TOTAL, P.BASELINE_START, P.BASELINE_END)
    out = [rounded(m).withColumn("run", F.lit(name)) for name, m in runs.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("interval_anomalies")
def q_interval_anomalies(spark, sf_dir):
    alerts = D.interval_anomalies(interval_events(spark, sf_dir), _model(spark, sf_dir),
                                  P.DETECT_START, P.DETECT_END, P.METRIC_COLUMNS, P.Z_LIMIT, source_ts="ts")
    return rounded(alerts)


@register("alert_messages")
def q_alert_messages(spark, sf_dir):
    """The text of every interval alert."""
    alerts = D.interval_anomalies(interval_events(spark, sf_dir), _model(spark, sf_dir),
                                  P.DETECT_START, P.DETECT_END, P.METRIC_COLUMNS, P.Z_LIMIT, source_ts="ts")
    return D.alert_messages(alerts).select("interval_ts", "metric_key", "message")


@register("pair_alert_messages")
def q_pair_alert_messages(spark, sf_dir):
    """The text of every directed pair's check."""
    scored = C.conflict_anomaly(edges(spark, sf_dir), P.AS_OF, P.DAYS, P.THRESHOLD, until=P.AS_OF)
    return C.pair_messages(scored, P.THRESHOLD).select("src", "dst", "message")


@register("running_stats")
def q_running_stats(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return rounded(B.running_stats(ev, "event_type", "value"))


@register("skipped_intervals")
def q_skipped_intervals(spark, sf_dir):
    return CV.skipped_intervals(spark, interval_events(spark, sf_dir), P.LOG_START, P.LOG_END)


@register("missing_days")
def q_missing_days(spark, sf_dir):
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"))
    return CV.missing_days(spark, days, P.MONTH_FIRST, P.MONTH_LAST)


# ---------------------------------------------------------------------------
# mentions, countries, prices, briefing, samples
# ---------------------------------------------------------------------------

def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@register("entity_mentions")
def q_entity_mentions(spark, sf_dir):
    found = M.mentions(_documents(spark, sf_dir), P.TERMS, ["text"])
    return M.mention_counts(spark, found, P.TERMS)


@register("entity_mentions_indexed")
def q_entity_mentions_indexed(spark, sf_dir):
    """Mentions of words and phrases by the first-word index; every term is reported, zero included."""
    found = TI.indexed_mentions(_documents(spark, sf_dir), TI.term_index(spark, P.INDEXED_TERMS), ["text"])
    return M.mention_counts(spark, found, P.INDEXED_TERMS)


@register("entity_first_mentions")
def q_entity_first_mentions(spark, sf_dir):
    found = M.mentions(_documents(spark, sf_dir), P.TERMS, ["text"])
    return M.first_mentions(found, P.FIRST_K).select("entity", "priority", "rank", "doc_id")


@register("first_tracked_entity")
def q_first_tracked_entity(spark, sf_dir):
    # the hits are thin and read three times: landed, so that the texts are searched once
    path = scratch_path(spark, "mentions")
    found = M.mentions(_documents(spark, sf_dir), P.TERMS, ["text"], keep=["source"])
    found.write.parquet(path)
    return M.first_tracked_entity(spark.read.schema(found.schema).parquet(path), P.FIRST_K, show_col="source")


@register("country_pattern")
def q_country_pattern(spark, sf_dir):
    return T.country_bindings(v_triples(spark, sf_dir))


@register("country_pattern_star")
def q_country_pattern_star(spark, sf_dir):
    return T.country_star(v_triples(spark, sf_dir))


@register("country_nodes")
def q_country_nodes(spark, sf_dir):
    return T.merge_countries(G.empty_graph(spark)["countries"], T.country_bindings(v_triples(spark, sf_dir)))


@register("sparql_bindings_flatten")
def q_sparql_bindings_flatten(spark, sf_dir):
    path = scratch_path(spark, "bindings")
    SP.write_bindings(T.country_bindings(v_triples(spark, sf_dir)), path)
    return SP.read_bindings(spark, path)


@register("prices_scan")
def q_prices_scan(spark, sf_dir):
    path = scratch_path(spark, "prices")
    PR.write_prices(v_prices(spark, sf_dir), path)
    return PR.read_prices(spark, path)


def _signal(spark, sf_dir):
    return FU.event_signal(clean_interactions(spark, sf_dir, "ticker"), key="ticker")


@register("prices_events_daily")
def q_prices_events_daily(spark, sf_dir):
    return FU.prices_with_events(v_prices(spark, sf_dir), _signal(spark, sf_dir))


@register("prices_events_asof")
def q_prices_events_asof(spark, sf_dir):
    return FU.events_with_latest_price(_signal(spark, sf_dir), v_prices(spark, sf_dir))


@register("briefing_rows")
def q_briefing_rows(spark, sf_dir):
    rows = clean_interactions(spark, sf_dir, "ticker")
    return rounded(BR.briefing_rows(G.interaction_edges(rows), P.AS_OF, P.DAYS, P.THRESHOLD, until=P.AS_OF,
                                    prices=v_prices(spark, sf_dir)))


@register("column_profile")
def q_column_profile(spark, sf_dir):
    return SA.column_profile(table(spark, sf_dir, "lineitem"))


@register("news_sample")
def q_news_sample(spark, sf_dir):
    return SA.sample_rows(_documents(spark, sf_dir), "doc_id", P.FIRST_K)


# ---------------------------------------------------------------------------
# real formats: land derived data in the shared scratch area and read it back
# ---------------------------------------------------------------------------

@register("event_scan_positional")
def q_event_scan_positional(spark, sf_dir):
    path = scratch_path(spark, "exports")
    EX.write_export_tsv(interactions(spark, sf_dir), path)
    return valid_events(EX.read_export_tsv(spark, path)).select(*EVENT_COLUMNS)


def _landed_zips(spark, sf_dir) -> str:
    """A folder of zipped exports, one or more a year, with archives that cannot be read among them."""
    path = scratch_path(spark, "zips")
    src = interactions(spark, sf_dir).withColumn(
        "stamp", F.concat(F.substring("sqldate", 1, 4), F.lit("0101000000")))
    landed = EX.write_export_zips(src, path, "stamp")
    landed.write.format("noop").mode("overwrite").save()
    EX.land_bad_archives(path)
    return path


@register("zip_stream_ingest")
def q_zip_stream_ingest(spark, sf_dir):
    """The same archives as a stream, a part per archive and a commit per batch, started twice."""
    path, root, ckpt = _landed_zips(spark, sf_dir), scratch_path(spark, "archives"), scratch_path(spark, "ckpt")
    for _ in range(2):
        ZS.start_archive_ingest(spark, path, root, ckpt, max_files=16).awaitTermination()
    return valid_events(ZS.stored_rows(spark, root)).select(*EVENT_COLUMNS)


@register("event_zip_scan")
def q_event_zip_scan(spark, sf_dir):
    path = _landed_zips(spark, sf_dir)
    return valid_events(EX.read_export_zips(spark, path)).select(*EVENT_COLUMNS)


@register("interval_log_roundtrip")
def q_interval_log_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "interval_log")
    # names with spaces at both ends and a character outside latin-1 must come back unchanged
    padded = F.when(F.col("event_code").endswith("1"), F.concat(F.lit("  "), "actor1_name", F.lit(" \u20ac ")))
    clean = (clean_interactions(spark, sf_dir).withColumn("actor1_name", F.coalesce(padded, F.col("actor1_name")))
             .withColumn("interval_ts", day_start("sqldate")))
    # the fixture spans seven years at a few hundred rows per day: month partitions
    IL.write_interval_log(clean, path, granularity="month", compression="gzip")
    return IL.read_interval_log(spark, path, granularity="month").select("interval_timestamp", *EVENT_COLUMNS)


# ---------------------------------------------------------------------------
# streaming twins: land derived data as files, run the stream to completion
# (availableNow), read its sink; the batch oracle applies unchanged
# ---------------------------------------------------------------------------

def _full_event_columns(df: DataFrame) -> DataFrame:
    return df.select("interval_ts", *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
                                      for c in EVENT_COLUMNS])


@register("interval_anomalies_stream")
def q_interval_anomalies_stream(spark, sf_dir):
    model_path = scratch_path(spark, "model")
    out, ckpt = scratch_path(spark, "alerts"), scratch_path(spark, "alerts-ckpt")
    _model(spark, sf_dir).write.parquet(model_path)
    ts = F.col("interval_ts")
    run = interval_events(spark, sf_dir).filter((ts >= ntz(P.DETECT_START)) & (ts < ntz(P.DETECT_END)))
    landing = _landed_halves(spark, sf_dir, run)
    q = SD.start_interval_alerts(spark, landing, lambda: spark.read.parquet(model_path), out, ckpt,
                                 P.METRIC_COLUMNS, P.Z_LIMIT, recursive=True, max_files=1)
    q.awaitTermination()
    return rounded(SD.read_alerts(spark, out))


def _landed_halves(spark, sf_dir, rows: DataFrame) -> str:
    """``rows`` as landed files; every interval lies in two of them, which different micro-batches read."""
    landing = scratch_path(spark, "landing")
    for half in (0, 1):
        IL.write_interval_log(_full_event_columns(rows.filter(F.col("event_id") % 2 == half)), f"{landing}/{half}", granularity="month")
    return landing


@register("interval_alerts_stateful")
def q_interval_alerts_stateful(spark, sf_dir):
    """Interval scoring by streaming state, scores restated as later files come."""
    out, ckpt, model_path = scratch_path(spark, "scores"), scratch_path(spark, "scores-ckpt"), scratch_path(spark, "model")
    _model(spark, sf_dir).write.parquet(model_path)
    ts = F.col("interval_ts")
    run = interval_events(spark, sf_dir).filter((ts >= ntz(P.DETECT_START)) & (ts < ntz(P.DETECT_END)))
    SF.start_stateful_alerts(spark, _landed_halves(spark, sf_dir, run), spark.read.parquet(model_path), out, ckpt, P.METRIC_COLUMNS,
                             P.Z_LIMIT, delay="60 days", recursive=True, max_files=1).awaitTermination()
    return rounded(SF.current_alerts(spark, out))


@register("stream_counters")
def q_stream_counters(spark, sf_dir):
    """Rows loaded and skipped by a stream over the whole log, as its listener has counted them."""
    out, ckpt, counters, model_path = (scratch_path(spark, n) for n in ("scores", "scores-ckpt", "counters", "model"))
    _model(spark, sf_dir).write.parquet(model_path)
    rows = v_interval_events(spark, sf_dir)
    unnamed = F.when(F.col("event_id") % 10 != 0, F.col("event_root_code"))  # a tenth of the rows has no root code
    listener = SF.StreamCounters(spark, counters)
    spark.streams.addListener(listener)
    try:
        SF.start_stateful_alerts(spark, _landed_halves(spark, sf_dir, rows.withColumn("event_root_code", unnamed)), spark.read.parquet(model_path),
                                 out, ckpt, P.METRIC_COLUMNS, P.Z_LIMIT, delay="60 days", recursive=True, max_files=1).awaitTermination()
        SF.wait_for_listeners(spark)
    finally:
        spark.streams.removeListener(listener)
    return SF.read_counters(spark, counters).agg(F.sum("loaded").alias("loaded"), F.sum("skipped").alias("skipped"), F.sum("late").alias("late"))


@register("running_stats_stream")
def q_running_stats_stream(spark, sf_dir):
    landing, out, ckpt = (scratch_path(spark, "events"), scratch_path(spark, "rs"),
                          scratch_path(spark, "rs-ckpt"))
    ev = table(spark, sf_dir, "events")
    # a file per day and task; the stream takes a fixed number of files at a time
    (ev.select("event_type", "value", F.to_date("ts").alias("day")).hint("rebalance", "day")
     .write.partitionBy("day").parquet(landing))
    stream = (spark.readStream.schema("event_type string, value double, day date")
              .option("maxFilesPerTrigger", 16).parquet(landing))

    def keep(batch, batch_id):
        (batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out))

    q = (SS.running_stats_stream(stream, "event_type", "value").writeStream.outputMode("update")
         .option("checkpointLocation", ckpt).foreachBatch(keep).trigger(availableNow=True).start())
    q.awaitTermination()
    emitted = spark.read.parquet(out)
    latest = emitted.groupBy("event_type").agg(F.max_by(F.struct("n", "mean", "std_dev"), "batch_id").alias("s"))
    return rounded(latest.select("event_type", "s.n", "s.mean", "s.std_dev"))


@register("file_stream_ingest")
def q_file_stream_ingest(spark, sf_dir):
    return SI.read_graph(spark, _ingested(spark, sf_dir))["interactions"].drop("event_id")


@register("edges_compacted")
def q_edges_compacted(spark, sf_dir):
    """A stream of landed files into the clustered edge table, compacted as it goes."""
    landing, root, ckpt = scratch_path(spark, "landing"), scratch_path(spark, "edges"), scratch_path(spark, "ckpt")
    clean = clean_interactions(spark, sf_dir).withColumn("interval_ts", day_start("sqldate"))
    IL.write_interval_log(clean, landing, granularity="month")
    SI.start_edge_ingest(spark, landing, root, ckpt, compact_every=3, recursive=True, max_files=20).awaitTermination()
    return ES.edges(spark, root).drop("event_id")


@register("ingest_quarantine")
def q_ingest_quarantine(spark, sf_dir):
    """A landed log with broken files among it: sound files are stored and archived, broken ones stay."""
    landing, archive = scratch_path(spark, "landing"), scratch_path(spark, "archive")
    root, ckpt = scratch_path(spark, "graph"), scratch_path(spark, "ckpt")
    clean = clean_interactions(spark, sf_dir).withColumn("interval_ts", day_start("sqldate"))
    IL.write_interval_log(clean, landing, granularity="month")
    header = ",".join(["interval_timestamp", *EVENT_COLUMNS])
    whole = "2024-01-01T00:00:00+00:00" + ",x" * len(EVENT_COLUMNS)
    for name, row in (("long", whole + ",y,z"), ("stamp", "yesterday" + ",x" * len(EVENT_COLUMNS))):
        lines = spark.createDataFrame([(header,), (whole,), (row,)], "value string").coalesce(1)  # three lines of one file
        lines.write.option("compression", "none").text(f"{landing}/{name}")
    QU.start_quarantined_ingest(spark, landing, root, ckpt, archive, SI.apply_edge_batch, recursive=True, max_files=40,
                                glob="*.{csv,txt}").awaitTermination()
    QU.clean_up(spark, root, landing, ckpt, archive)
    left = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,txt}").load(landing).count()
    letters = QU.dead_letters(spark, root).count()
    if (left, letters) != (2, 2):
        raise AssertionError(f"{left} files left in the landing folder, {letters} dead letters")
    return ES.edges(spark, root).drop("event_id")


@register("file_stream_ingest_actors")
def q_file_stream_ingest_actors(spark, sf_dir):
    """Actor names of the stored graph; a graph of its own is reset and must be empty then."""
    root = _ingested(spark, sf_dir, own=True)
    G.reset_graph(spark, root)
    if SI.read_graph(spark, root)["actors"].head(1):
        raise AssertionError("actors survive the reset")
    return SI.read_graph(spark, _ingested(spark, sf_dir))["actors"].select("name", "type")


# ---------------------------------------------------------------------------
# stored tables, resume, fresh start, backfill, articles
# ---------------------------------------------------------------------------

def _landed_log(spark, sf_dir) -> str:
    """The folder of the whole log as landed files, written once per application and input; streams that read
    it leave it as it is."""
    key = (spark.sparkContext.applicationId, f"log of {sf_dir.rstrip('/')}")
    if not _landed(spark, key):
        path = scratch_path(spark, "landing")
        clean = clean_interactions(spark, sf_dir).withColumn("interval_ts", day_start("sqldate"))
        IL.write_interval_log(clean, path, granularity="month")
        _LANDED[key] = path
    return _LANDED[key]


def _ingested(spark, sf_dir, own: bool = False) -> str:
    """The folder of the graph tables after a stream ingest of the whole landed log. The ingest runs
    once per application and input; ``own`` makes one that the caller may change."""
    key = (spark.sparkContext.applicationId, f"graph of {sf_dir.rstrip('/')}")
    if not own and _landed(spark, key):
        return _LANDED[key]
    root, ckpt = scratch_path(spark, "graph"), scratch_path(spark, "ckpt")
    SI.start_graph_ingest(spark, _landed_log(spark, sf_dir), root, ckpt, recursive=True, max_files=200).awaitTermination()
    if not own:
        _LANDED[key] = root
    return root


@register("graph_counts_stored")
def q_graph_counts_stored(spark, sf_dir):
    """Nodes and relationships of the stored tables, countries included."""
    g = SI.read_graph(spark, _ingested(spark, sf_dir))
    countries = T.merge_countries(G.empty_graph(spark)["countries"], T.country_bindings(v_triples(spark, sf_dir)))
    return G.graph_counts(g["actors"], g["event_nodes"], g["interactions"], g["impacts"], [countries])


@register("interval_log_fresh_start")
def q_interval_log_fresh_start(spark, sf_dir):
    """A fresh start empties the log first: only the second write's rows are left."""
    path = scratch_path(spark, "interval_log")
    rows = _full_event_columns(interval_events(spark, sf_dir))
    cut = ntz(P.DETECT_START)
    IL.write_interval_log(rows.filter(F.col("interval_ts") < cut), path)
    IL.write_interval_log(rows.filter(F.col("interval_ts") >= cut), path, fresh=True)
    return IL.read_interval_log(spark, path).select("interval_timestamp", "event_root_code", "quad_class")


@register("resume_no_duplicates")
def q_resume_no_duplicates(spark, sf_dir):
    """A log processed in two runs around a resume marker, then a third run with nothing new."""
    out, marker = scratch_path(spark, "processed"), scratch_path(spark, "marker")
    rows = interval_events(spark, sf_dir).select("event_id", "interval_ts", "event_root_code")
    for until in (P.DETECT_START, P.LOG_END, P.LOG_END):
        new = IL.unprocessed(spark, rows.filter(F.col("interval_ts") < ntz(until)), marker)
        new.write.mode("append").parquet(out)
        IL.mark_processed(spark, marker, new)
    return spark.read.parquet(out)


class _Killed(RuntimeError):
    """Stands for the loss of a run's driver."""


@register("resume_after_crash")
def q_resume_after_crash(spark, sf_dir):
    """Runs over a growing log, one of which dies after its rows are written and before they are published."""
    root = scratch_path(spark, "runs")
    log = interval_events(spark, sf_dir).select("event_id", "interval_ts", "event_root_code")

    def dies(df):
        V.stage(df.withColumn("__run", F.lit("lost")), root, "__run")  # its rows are in the folder
        raise _Killed

    for until, work in ((P.DETECT_START, lambda df: df), (P.LOG_END, dies), (P.LOG_END, lambda df: df), (P.LOG_END, dies)):
        try:
            RS.run(spark, root, log.filter(F.col("interval_ts") < ntz(until)), work)
        except _Killed:
            pass
    RS.merge_runs(spark, root, "event_id bigint, interval_ts timestamp_ntz, event_root_code string", least=2)
    return RS.rows(spark, root, "event_id bigint, interval_ts timestamp_ntz, event_root_code string")


@register("windowed_counts_stream")
def q_windowed_counts_stream(spark, sf_dir):
    """Row-time windows over a stream; a row older than the watermark is dropped.

    The first batch holds the whole table, the second one row far ahead, which closes all
    windows, the third the first day again: late rows are judged by the watermark that the
    batch before the last one has left, and these are late."""
    landing, out, ckpt = scratch_path(spark, "events"), scratch_path(spark, "windows"), scratch_path(spark, "ckpt")
    ev = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("event_root_code"))
    ahead = spark.range(1).select(ntz(P.FAR_AHEAD).alias("ts"), F.lit("late").alias("event_root_code"))
    late = ev.filter(F.to_date("ts") == F.to_date(F.lit(P.MONTH_FIRST)))
    # each landing is followed by a run of the stream, so the batches are ordered however many files they have
    for k, rows in enumerate((ev, ahead, late)):
        rows.write.parquet(f"{landing}/{k}")
        stream = spark.readStream.schema(ev.schema).option("recursiveFileLookup", True).parquet(landing)
        q = (SD.windowed_counts(stream, "ts", ["event_root_code"]).writeStream.outputMode("append").format("parquet")
             .option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema("interval_start timestamp, metric_key string, n bigint").parquet(out).select(
        F.date_format("interval_start", "yyyy-MM-dd'T'HH:mm:ss").alias("interval_start"), "metric_key", "n")


@register("backfill_days")
def q_backfill_days(spark, sf_dir):
    """A day-partitioned table that holds two days of a month, completed by the backfill."""
    path = scratch_path(spark, "days")
    rows = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))
    (rows.filter(F.dayofmonth("day").isin(3, 17)).withColumn("event_id", -F.col("event_id"))
     .write.partitionBy("day").parquet(path))
    BF.backfill_days(spark, rows, path, P.MONTH_FIRST, P.MONTH_LAST)
    return spark.read.parquet(path).select("event_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@register("article_mentions")
def q_article_mentions(spark, sf_dir):
    """Tracked terms in the three name columns of positional article files."""
    path = scratch_path(spark, "articles")
    docs = _documents(spark, sf_dir).select(
        "doc_id", F.translate("text", "\t\n\r\"", "    ").alias("text"), "lang", "source")
    AR.write_article_file(docs.select(F.col("doc_id").cast("string").alias("record_id"),
                                      F.col("text").alias("organizations"), F.col("lang").alias("persons"),
                                      F.col("source").alias("locations")), path)
    rows = AR.read_article_file(spark, path)
    found = M.mentions(rows, P.TERMS, ["organizations", "persons", "locations"], id_col="record_id")
    return found.select("entity", "priority", F.col("record_id").cast("bigint").alias("doc_id"))


@register("prices_file_per_ticker")
def q_prices_file_per_ticker(spark, sf_dir):
    """Prices landed as one file per ticker, named by it, and read back."""
    path = scratch_path(spark, "prices")
    PR.write_price_files(v_prices(spark, sf_dir), path)
    return PR.read_prices(spark, path, layout="file_per_ticker")
