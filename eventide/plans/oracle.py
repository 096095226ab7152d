"""DuckDB SQL twins of the registered queries (same parameters, same column names)."""

from __future__ import annotations

from eventide.functions.nulls import na_sql
from eventide.functions.text import whole_word_sql
from eventide.functions.timefmt import days_before, sql_ts
from eventide.plans import params as P
from eventide.plans.views import EVENT_COLUMNS, SQL_VIEWS, with_views

ORACLE: dict[str, str] = {}
R = P.ROUND


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


# shared CTEs -----------------------------------------------------------------

CLEAN = ("SELECT " + ", ".join(f"{na_sql(c)} AS {c}" for c in EVENT_COLUMNS)
         + " FROM v_interactions")
CLEAN_F = f"SELECT * FROM ({CLEAN}) WHERE event_root_code IS NOT NULL AND event_root_code <> ''"
ACCEPTED = ("SELECT * FROM clean WHERE coalesce(actor1_name, '') <> '' AND coalesce(actor2_name, '') <> '' "
            "AND coalesce(event_code, '') <> ''")
EDGES = ("SELECT actor1_name AS src, actor2_name AS dst, event_code, event_root_code AS root_code, quad_class, "
         "goldstein_scale, avg_tone, sqldate AS date FROM accepted")
GRAPH = {"clean": CLEAN_F, "accepted": ACCEPTED, "edges": EDGES}


def graph_sql(sql: str, **extra: str) -> str:
    return with_views(sql, "v_interactions", extra={**GRAPH, **extra})


# projections / filters -------------------------------------------------------

oracle("valid_events", with_views("SELECT * FROM clean", "v_interactions", extra={"clean": CLEAN_F}))

# graph -------------------------------------------------------------------------

oracle("event_nodes", graph_sql(
    "SELECT 'GeopoliticalEvent' AS type, sqldate AS date, "
    "'GDELT Event ' || event_code || ' between ' || actor1_name || ' and ' || actor2_name AS description "
    "FROM accepted"))
oracle("interaction_edges", graph_sql("SELECT * FROM edges"))
# an impact names its event by the row of the line item in its file (the table is one file)
_ROWS = SQL_VIEWS["v_interactions"].replace("SELECT strftime", "SELECT l.event_row, strftime", 1).replace(
    "FROM lineitem l", "FROM (SELECT row_number() OVER () - 1 AS event_row, * FROM lineitem) l", 1)
_ROWS_F = f"SELECT event_row, {', '.join(f'{na_sql(c)} AS {c}' for c in EVENT_COLUMNS)} FROM numbered"
oracle("impact_edges", with_views(
    "SELECT event_row, unnest([actor1_name, actor2_name]) AS actor FROM accepted", extra={
        "numbered": _ROWS, "clean": f"SELECT * FROM ({_ROWS_F}) WHERE event_root_code IS NOT NULL AND event_root_code <> ''",
        "accepted": ACCEPTED}))
oracle("graph_counts", graph_sql(
    "SELECT CAST((SELECT count(*) FROM (SELECT actor1_name FROM accepted UNION SELECT actor2_name FROM accepted))"
    " + (SELECT count(*) FROM accepted) AS BIGINT) AS node_count, "
    "CAST(3 * (SELECT count(*) FROM accepted) AS BIGINT) AS rel_count"))

_ACTOR_SIDES = ("SELECT actor1_name AS name, actor1_code AS code, order_key, 1 AS side FROM v_actor_updates "
                "UNION ALL SELECT actor2_name, actor2_code, order_key, 2 FROM v_actor_updates")
_LAST_WRITE = ("SELECT name, code, 'Unknown' AS type FROM (SELECT name, code, row_number() OVER "
               "(PARTITION BY name ORDER BY order_key DESC, side DESC) AS rn FROM sides) WHERE rn = 1")
oracle("actor_nodes", with_views(_LAST_WRITE, "v_actor_updates", extra={"sides": _ACTOR_SIDES}))
oracle("actor_upsert_two_batches", ORACLE["actor_nodes"])
oracle("actor_upsert_bucketed", ORACLE["actor_nodes"])

oracle("top_actors", graph_sql(
    f"SELECT src AS actor, count(*) AS relationship_count FROM edges GROUP BY src "
    f"ORDER BY relationship_count DESC, actor LIMIT {P.TOP_K}"))
oracle("actor_recent_interactions", graph_sql(
    f"SELECT dst AS neighbor, event_code, date FROM edges WHERE src = '{P.ACTOR}' "
    f"ORDER BY date DESC NULLS FIRST, dst, event_code LIMIT {P.RECENT_K}"))
oracle("actor_recent_interactions_clustered", ORACLE["actor_recent_interactions"])
oracle("actor_recent_interactions_all", graph_sql(
    f"SELECT actor, rank, neighbor, event_code, date FROM (SELECT src AS actor, "
    f"CAST(row_number() OVER (PARTITION BY src ORDER BY date DESC NULLS FIRST, dst, event_code) AS BIGINT) AS rank, "
    f"dst AS neighbor, event_code, date FROM edges) WHERE rank <= {P.RECENT_K}"))

# actor-pair conflicts ------------------------------------------------------------


def _conf(pair: bool = False, code: str | None = None, until: bool = True) -> str:
    where = "TRY_CAST(goldstein_scale AS DOUBLE) < 0"
    if until:
        where += f" AND date <= '{P.AS_OF}'"
    if pair:
        where += f" AND src = '{P.PAIR[0]}' AND dst = '{P.PAIR[1]}'"
    if code:
        where += f" AND root_code = '{code}'"
    return f"SELECT * FROM edges WHERE {where}"


_DAILY = "SELECT src, dst, date, count(*) AS daily_count FROM conf GROUP BY src, dst, date"
_BASE_COLS = (f"round(avg(daily_count), {R}) AS mean, "
              f"round(greatest(coalesce(stddev_samp(daily_count), 0.0), 1.0), {R}) AS std_dev, "
              "CAST(sum(daily_count) AS BIGINT) AS total_events, count(*) AS days_with_events")

oracle("conflict_daily_counts", graph_sql(_DAILY, conf=_conf(until=False)))
oracle("conflict_baseline", graph_sql(f"SELECT src, dst, {_BASE_COLS} FROM daily GROUP BY src, dst",
                                      conf=_conf(pair=True, until=False), daily=_DAILY))
oracle("conflict_baseline_by_code", graph_sql(f"SELECT src, dst, {_BASE_COLS} FROM daily GROUP BY src, dst",
                                              conf=_conf(pair=True, code=P.PAIR_CODE, until=False), daily=_DAILY))
oracle("conflict_recent_count", graph_sql(
    f"SELECT CAST(count(*) AS BIGINT) AS recent_count FROM conf "
    f"WHERE date >= '{days_before(P.AS_OF, P.PAIR_RECENT_DAYS)}'", conf=_conf(pair=True)))


def _anomaly(pair: bool) -> str:
    cutoff = days_before(P.AS_OF, P.DAYS)
    base = (f"SELECT src, dst, avg(daily_count) AS mean, "
            f"greatest(coalesce(stddev_samp(daily_count), 0.0), 1.0) AS std_dev, "
            f"CAST(sum(daily_count) AS BIGINT) AS total_events, count(*) AS days_with_events, "
            f"CAST(coalesce(sum(CASE WHEN date >= '{cutoff}' THEN daily_count END), 0) AS BIGINT) AS recent_count "
            f"FROM daily GROUP BY src, dst")
    sql = (f"SELECT src, dst, round(mean, {R}) AS mean, round(std_dev, {R}) AS std_dev, total_events, "
           f"days_with_events, recent_count, round(recent_count / {float(P.DAYS)}, {R}) AS recent_rate, "
           f"round((recent_count / {float(P.DAYS)} - mean) / std_dev, {R}) AS z_score, "
           f"(recent_count / {float(P.DAYS)} - mean) / std_dev > {float(P.THRESHOLD)} AS is_anomaly FROM base")
    return graph_sql(sql, conf=_conf(pair=pair), daily=_DAILY, base=base)


oracle("conflict_anomaly", _anomaly(True))
oracle("conflict_anomaly_all_pairs", _anomaly(False))
oracle("pair_alert_messages", "SELECT src, dst, CASE WHEN is_anomaly THEN '>> ALERT: Anomaly detected! Z-score (' || "
       f"printf('%.2f', z_score) || ') exceeds threshold of {float(P.THRESHOLD)}. <<' ELSE "
       "'>> No anomaly detected. Event rate is within normal parameters. <<' END AS message "
       f"FROM ({ORACLE['conflict_anomaly_all_pairs']})")

# interval log ------------------------------------------------------------------

_IEV = (f"SELECT event_id, ts, interval_ts, {na_sql('event_root_code')} AS event_root_code, "
        f"{na_sql('quad_class')} AS quad_class FROM v_interval_events")
_IEV_F = f"SELECT * FROM ({_IEV}) WHERE event_root_code IS NOT NULL AND event_root_code <> ''"
_COUNTS = " UNION ALL ".join(
    f"SELECT '{c}' AS metric_col, {c} AS metric_val, '{c}_' || {c} AS metric_key, interval_ts, count(*) AS n "
    f"FROM iev WHERE {c} IS NOT NULL GROUP BY {c}, interval_ts" for c in P.METRIC_COLUMNS)
_SIG = f"SELECT metric_key, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY metric_key HAVING sum(n) > {P.MIN_TOTAL}"
_SPINE = (f"SELECT unnest(generate_series({sql_ts(P.BASELINE_START)}, {sql_ts(P.BASELINE_END)}, "
          f"INTERVAL 15 MINUTE)) AS interval_ts")
_DENSE = ("SELECT s.metric_key, coalesce(c.n, 0) AS n FROM sig s CROSS JOIN spine sp LEFT JOIN counts c "
          "ON c.metric_key = s.metric_key AND c.interval_ts = sp.interval_ts")
_MODEL = ("SELECT metric_key, avg(n) AS mean, stddev_samp(n) AS std_dev, CAST(sum(n) AS BIGINT) AS total_occurrences "
          "FROM dense GROUP BY metric_key")
_MODEL_OUT = (f"SELECT metric_key, round(mean, {R}) AS mean, round(std_dev, {R}) AS std_dev, total_occurrences "
              f"FROM model")


def interval_sql(sql: str, **extra: str) -> str:
    return with_views(sql, "v_interval_events", extra={"iev": _IEV_F, "counts": _COUNTS, **extra})


oracle("interval_stamp", with_views(
    "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts) AS interval_ts, "
    "strftime(time_bucket(INTERVAL '15 minutes', ts), '%Y%m%d%H%M%S') AS interval_key, "
    "strftime(time_bucket(INTERVAL '15 minutes', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS interval_timestamp "
    "FROM events"))
oracle("interval_counts", interval_sql("SELECT * FROM counts"))
oracle("interval_counts_grouping_sets", ORACLE["interval_counts"])
oracle("significant_types", interval_sql(_SIG))
_MODEL_CTES = {"sig": _SIG, "spine": _SPINE, "dense": _DENSE, "model": _MODEL}
oracle("event_baseline_dense", interval_sql(_MODEL_OUT, **_MODEL_CTES))
oracle("event_baseline_sparse", ORACLE["event_baseline_dense"])
oracle("model_state_json", ORACLE["event_baseline_dense"])
oracle("model_state_roundtrip", ORACLE["event_baseline_dense"])


def _range_model(run: str, start, end, events: str = "iev") -> str:
    """A zero-filled model of one range over a named event source, as a row source of its own."""
    return (f"(WITH counts AS ({_COUNTS.replace('FROM iev', f'FROM {events}')}), sig AS ({_SIG}), spine AS (SELECT unnest(generate_series("
            f"{sql_ts(start)}, {sql_ts(end)}, INTERVAL 15 MINUTE)) AS interval_ts), dense AS ({_DENSE}), model AS ({_MODEL}) "
            f"SELECT '{run}' AS run, m.* FROM ({_MODEL_OUT}) m)")


_RESTATED = (f"SELECT * FROM iev WHERE NOT (CAST(interval_ts AS DATE) = DATE '{P.RESTATED_DAY}' "
             f"AND coalesce(quad_class, '') = '{P.RESTATED_WITHOUT}')")
oracle("baseline_incremental", with_views(" UNION ALL ".join([
    _range_model("month", P.BASELINE_START, P.BASELINE_END), _range_model("cut", P.CUT_START, P.CUT_END),
    _range_model("restated", P.BASELINE_START, P.BASELINE_END, "restated")]), "v_interval_events",
    extra={"iev": _IEV_F, "restated": _RESTATED}))
oracle("interval_anomalies", interval_sql(
    f"SELECT c.interval_ts, c.metric_key, c.n AS current_count, round(m.mean, {R}) AS mean, "
    f"round(m.std_dev, {R}) AS std_dev, round((c.n - m.mean) / m.std_dev, {R}) AS z_score "
    f"FROM counts c JOIN model m ON c.metric_key = m.metric_key "
    f"WHERE c.interval_ts >= {sql_ts(P.DETECT_START)} AND c.interval_ts < {sql_ts(P.DETECT_END)} "
    f"AND m.std_dev > 0 AND abs((c.n - m.mean) / m.std_dev) > {P.Z_LIMIT}", **_MODEL_CTES))
oracle("alert_messages", "SELECT interval_ts, metric_key, 'ALERT: Anomaly in ' || chr(39) || metric_key || chr(39) || "
       "' (Z-Score: ' || printf('%.2f', z_score) || '). Current: ' || CAST(current_count AS VARCHAR) || "
       f"', Baseline Mean: ' || printf('%.2f', mean) AS message FROM ({ORACLE['interval_anomalies']})")
oracle("running_stats", with_views(
    f"SELECT event_type, count(value) AS n, round(avg(value), {R}) AS mean, "
    f"round(coalesce(stddev_samp(value), 0.0), {R}) AS std_dev FROM events GROUP BY event_type"))
oracle("skipped_intervals", interval_sql(
    f"SELECT interval_ts FROM (SELECT unnest(generate_series({sql_ts(P.LOG_START)}, {sql_ts(P.LOG_END)}, "
    f"INTERVAL 15 MINUTE)) AS interval_ts) sp WHERE interval_ts < {sql_ts(P.LOG_END)} "
    f"AND interval_ts NOT IN (SELECT interval_ts FROM iev)"))
oracle("missing_days", with_views(
    f"SELECT strftime(day, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(DATE '{P.MONTH_FIRST}', "
    f"DATE '{P.MONTH_LAST}', INTERVAL 1 DAY)) AS day) cal "
    f"WHERE CAST(day AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events)"))

# mentions ----------------------------------------------------------------------

_TERMS = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(P.TERMS)) + \
    ") t(entity, priority)"
_FOUND = " UNION ALL ".join(
    f"SELECT '{t}' AS entity, {i} AS priority, doc_id, source FROM documents WHERE {whole_word_sql('text', t)}"
    for i, t in enumerate(P.TERMS))
_M = {"terms": _TERMS, "found": _FOUND}

oracle("entity_mentions", with_views(
    "SELECT t.entity, t.priority, CAST(coalesce(c.n, 0) AS BIGINT) AS n_mentions FROM terms t LEFT JOIN "
    "(SELECT entity, count(*) AS n FROM found GROUP BY entity) c ON c.entity = t.entity", extra=_M))
oracle("entity_mentions_indexed", " UNION ALL ".join(
    f"SELECT '{t}' AS entity, {i} AS priority, count(*) AS n_mentions FROM documents WHERE {whole_word_sql('text', t)}"
    for i, t in enumerate(P.INDEXED_TERMS)))
oracle("entity_first_mentions", with_views(
    f"SELECT entity, priority, rank, doc_id FROM (SELECT entity, priority, doc_id, "
    f"CAST(row_number() OVER (PARTITION BY entity ORDER BY doc_id) AS BIGINT) AS rank FROM found) "
    f"WHERE rank <= {P.FIRST_K}", extra=_M))
oracle("first_tracked_entity", with_views(
    f"SELECT entity, n_mentions, rank, doc_id, coalesce(source, '(No XML content)') AS content FROM ("
    f"SELECT f.entity, CAST(w.n AS BIGINT) AS n_mentions, f.doc_id, f.source, "
    f"CAST(row_number() OVER (ORDER BY f.doc_id) AS BIGINT) AS rank FROM found f JOIN "
    f"(SELECT priority, count(*) AS n FROM found GROUP BY priority ORDER BY priority LIMIT 1) w "
    f"ON f.priority = w.priority) WHERE rank <= {P.FIRST_K}", extra=_M))

# triples -----------------------------------------------------------------------

_BINDINGS = (
    "SELECT c.s AS uri, n.o AS name, i.o AS iso_code, cl.o AS capital FROM "
    "(SELECT s FROM v_triples WHERE p = 'type' AND o = 'Country') c "
    "JOIN (SELECT s, o FROM v_triples WHERE p = 'label' AND lang = 'en') n ON n.s = c.s "
    "LEFT JOIN (SELECT s, o FROM v_triples WHERE p = 'isoCode') i ON i.s = c.s "
    "JOIN (SELECT s, o FROM v_triples WHERE p = 'capital') cap ON cap.s = c.s "
    "JOIN (SELECT s, o FROM v_triples WHERE p = 'label' AND lang = 'en') cl ON cl.s = cap.o")
oracle("country_pattern", with_views("SELECT * FROM b", "v_triples", extra={"b": _BINDINGS}))
oracle("sparql_bindings_flatten", ORACLE["country_pattern"])
oracle("country_nodes", with_views(
    "SELECT name, iso_code, capital, uri, 'Country' AS type, 'Unknown' AS region FROM (SELECT *, row_number() "
    "OVER (PARTITION BY name ORDER BY uri DESC NULLS LAST, iso_code DESC NULLS LAST, capital DESC NULLS LAST) "
    "AS rn FROM b) WHERE rn = 1", "v_triples", extra={"b": _BINDINGS}))

# prices --------------------------------------------------------------------------

_CLEAN_T = (f"SELECT ticker, {', '.join(f'{na_sql(c)} AS {c}' for c in EVENT_COLUMNS)} FROM v_interactions_t")
_SIGNAL = ("SELECT ticker, CAST(strptime(sqldate, '%Y%m%d') AS DATE) AS event_date, count(*) AS n_events, "
           "count(*) FILTER (WHERE TRY_CAST(goldstein_scale AS DOUBLE) < 0) AS n_conflicts "
           "FROM cleant WHERE event_root_code IS NOT NULL AND event_root_code <> '' GROUP BY ALL")
_P = {"cleant": _CLEAN_T, "sig": _SIGNAL}

oracle("prices_scan", with_views("SELECT * FROM v_prices", "v_prices"))
oracle("prices_events_daily", with_views(
    "SELECT p.ticker, p.price_date, p.open, p.high, p.low, p.close, p.volume, s.n_events, s.n_conflicts "
    "FROM v_prices p JOIN sig s ON s.ticker = p.ticker AND s.event_date = p.price_date",
    "v_interactions_t", "v_prices", extra=_P))
oracle("prices_events_asof", with_views(
    "SELECT s.ticker, s.event_date, s.n_events, s.n_conflicts, p.price_date, p.close "
    "FROM sig s ASOF LEFT JOIN v_prices p ON s.ticker = p.ticker AND s.event_date >= p.price_date",
    "v_interactions_t", "v_prices", extra=_P))

# briefing ------------------------------------------------------------------------

_cut = days_before(P.AS_OF, P.DAYS)
_ANOM = (f"SELECT src, dst, (recent_count / {float(P.DAYS)} - mean) / std_dev AS z_score, "
         f"(recent_count / {float(P.DAYS)} - mean) / std_dev > {float(P.THRESHOLD)} AS is_anomaly FROM ("
         f"SELECT src, dst, avg(daily_count) AS mean, greatest(coalesce(stddev_samp(daily_count), 0.0), 1.0) AS std_dev, "
         f"coalesce(sum(CASE WHEN date >= '{_cut}' THEN daily_count END), 0) AS recent_count FROM daily GROUP BY src, dst)")
_TOPC = ("SELECT src AS actor, string_agg(dst || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY r) "
         "AS top_counterparties FROM (SELECT src, dst, n, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) "
         "AS r FROM (SELECT src, dst, count(*) AS n FROM edges GROUP BY src, dst)) WHERE r <= 3 GROUP BY src")
_ACC_T = ("SELECT * FROM cleant WHERE event_root_code IS NOT NULL AND event_root_code <> '' "
          "AND coalesce(actor1_name, '') <> '' AND coalesce(actor2_name, '') <> '' AND coalesce(event_code, '') <> ''")
_EDGES_T = ("SELECT actor1_name AS src, actor2_name AS dst, event_code, event_root_code AS root_code, quad_class, "
            "goldstein_scale, avg_tone, sqldate AS date FROM acc")
_TOPT = ("SELECT actor, ticker AS top_ticker FROM (SELECT actor1_name AS actor, ticker, row_number() OVER "
         "(PARTITION BY actor1_name ORDER BY count(*) DESC, ticker) AS r FROM acc GROUP BY actor1_name, ticker) "
         "WHERE r = 1")
_LAST = ("SELECT ticker, arg_max(price_date, price_date) AS latest_close_date, arg_max(close, price_date) AS latest_close "
         "FROM v_prices GROUP BY ticker")
oracle("briefing_rows", with_views(
    f"SELECT d.actor, d.n_interactions, t.top_counterparties, CAST(coalesce(a.n_alerts, 0) AS BIGINT) AS n_alerts, "
    f"round(a.max_conflict_z, {R}) AS max_conflict_z, d.actor || ': ' || CAST(d.n_interactions AS VARCHAR) || "
    f"' interactions; top counterparties: ' || coalesce(t.top_counterparties, 'none') || '; conflict alerts: ' || "
    f"CAST(coalesce(a.n_alerts, 0) AS VARCHAR) AS briefing, tt.top_ticker, lc.latest_close_date, "
    f"round(lc.latest_close, {R}) AS latest_close "
    f"FROM (SELECT src AS actor, count(*) AS n_interactions FROM edges GROUP BY src) d "
    f"LEFT JOIN topc t ON t.actor = d.actor LEFT JOIN (SELECT src AS actor, count(*) FILTER (WHERE is_anomaly) "
    f"AS n_alerts, max(z_score) AS max_conflict_z FROM anom GROUP BY src) a ON a.actor = d.actor "
    f"LEFT JOIN topt tt ON tt.actor = d.actor LEFT JOIN lastc lc ON lc.ticker = tt.top_ticker",
    "v_interactions_t", "v_prices",
    extra={"cleant": _CLEAN_T, "acc": _ACC_T, "edges": _EDGES_T, "conf": _conf(), "daily": _DAILY, "anom": _ANOM,
           "topc": _TOPC, "topt": _TOPT, "lastc": _LAST}))

# samples -------------------------------------------------------------------------

_LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
       "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_keep = sorted(set(range(5)) | set(range(len(_LI) - 5, len(_LI))))
oracle("column_profile", with_views(" UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS ordinal, '{_LI[i]}' AS column_name, CAST({_LI[i]} AS VARCHAR) AS value, "
    f"CAST({len(_LI)} AS BIGINT) AS n_columns FROM f" for i in _keep),
    extra={"f": "SELECT * FROM lineitem ORDER BY ALL LIMIT 1"}))
oracle("news_sample", f"SELECT * FROM documents ORDER BY doc_id LIMIT {P.FIRST_K}")

# real formats ----------------------------------------------------------------------

oracle("event_scan_positional", ORACLE["valid_events"])
oracle("event_zip_scan", ORACLE["valid_events"])
oracle("interval_log_roundtrip", with_views(
    "SELECT strftime(strptime(sqldate, '%Y%m%d'), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS interval_timestamp, * REPLACE "
    "(CASE WHEN event_code LIKE '%1' THEN '  ' || actor1_name || ' \u20ac ' ELSE actor1_name END AS actor1_name) "
    "FROM clean", "v_interactions", extra={"clean": CLEAN_F}))
oracle("interval_log_fresh_start", interval_sql(
    "SELECT strftime(interval_ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS interval_timestamp, event_root_code, quad_class "
    f"FROM iev WHERE interval_ts >= {sql_ts(P.DETECT_START)}"))
oracle("resume_no_duplicates", interval_sql(
    f"SELECT event_id, interval_ts, event_root_code FROM iev WHERE interval_ts < {sql_ts(P.LOG_END)}"))
oracle("backfill_days", "SELECT CASE WHEN day(ts) IN (3, 17) THEN -event_id ELSE event_id END AS event_id, "
       f"strftime(ts, '%Y-%m-%d') AS day FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '{P.MONTH_FIRST}' AND DATE '{P.MONTH_LAST}'")
oracle("article_mentions", "SELECT entity, priority, doc_id FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS entity, {i} AS priority, doc_id FROM documents WHERE "
    + " OR ".join(whole_word_sql(c, t) for c in ("text", "lang", "source")) for i, t in enumerate(P.TERMS)) + ")")
oracle("prices_file_per_ticker", ORACLE["prices_scan"])
oracle("windowed_counts_stream",
       "SELECT strftime(time_bucket(INTERVAL '15 minutes', ts), '%Y-%m-%dT%H:%M:%S') AS interval_start, "
       "'event_root_code_' || event_type AS metric_key, count(*) AS n FROM events GROUP BY ALL")

# streaming twins --------------------------------------------------------------------

oracle("interval_anomalies_stream", ORACLE["interval_anomalies"])
oracle("interval_alerts_stateful", ORACLE["interval_anomalies"])
oracle("stream_counters", with_views(
    f"SELECT count(*) AS loaded, count(*) - count(CASE WHEN coalesce({na_sql('event_root_code')}, '') <> '' AND event_id % 10 <> 0 "
    "THEN 1 END) AS skipped, CAST(0 AS BIGINT) AS late FROM v_interval_events", "v_interval_events"))
oracle("running_stats_stream", ORACLE["running_stats"])
oracle("file_stream_ingest", ORACLE["interaction_edges"])
oracle("edges_compacted", ORACLE["file_stream_ingest"])
oracle("ingest_quarantine", ORACLE["file_stream_ingest"])
oracle("file_stream_ingest_actors", graph_sql(
    "SELECT name, 'Unknown' AS type FROM (SELECT actor1_name AS name FROM accepted UNION SELECT actor2_name FROM accepted)"))
oracle("graph_counts_stored", with_views(
    "SELECT CAST((SELECT count(*) FROM (SELECT actor1_name FROM accepted UNION SELECT actor2_name FROM accepted))"
    " + (SELECT count(*) FROM accepted) + (SELECT count(DISTINCT name) FROM b) AS BIGINT) AS node_count, "
    "CAST(3 * (SELECT count(*) FROM accepted) AS BIGINT) AS rel_count", "v_interactions", "v_triples",
    extra={**GRAPH, "b": _BINDINGS}))

oracle("resume_after_crash", ORACLE["resume_no_duplicates"])
oracle("country_pattern_star", ORACLE["country_pattern"])
oracle("zip_stream_ingest", ORACLE["event_zip_scan"])
