"""Per-actor briefing rows (E2): the fused facts an analyst (or a model prompt) reads.

One row per actor with its out-degree, its top counterparties and its conflict alerts.
All of it comes from one grouping-sets pre-aggregate of the edges — per (src, dst, date)
and per (src, ticker), far smaller than the edges — materialised once with a reliable
checkpoint (each branch prunes it differently, so Spark would otherwise recompute the
edges per branch). Each list is bounded (top ``k`` per actor) before it is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.numeric import to_double
from eventide.operators.conflict import score_pairs


def top_counterparties(pairs: DataFrame, k: int = 3) -> DataFrame:
    """``pairs``: (src, dst, n). Text ``"dst (n), ..."`` of the ``k`` largest per src."""
    w = Window.partitionBy("src").orderBy(F.col("n").desc(), F.col("dst").asc())
    top = pairs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return top.groupBy(F.col("src").alias("actor")).agg(
        F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("r", "dst", "n"))),
                                      lambda x: F.concat(x["dst"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))))
        .alias("top_counterparties"))


def top_ticker(ticker_counts: DataFrame) -> DataFrame:
    """``ticker_counts``: (actor, ticker, n). The ticker each actor's events touch most
    (ties: smallest name); a per-actor top-1 (map-side limited window)."""
    w = Window.partitionBy("actor").orderBy(F.col("n").desc(), F.col("ticker").asc())
    return (ticker_counts.withColumn("r", F.row_number().over(w)).filter(F.col("r") == 1)
            .select("actor", F.col("ticker").alias("top_ticker")))


def latest_close(prices: DataFrame) -> DataFrame:
    """Last close per ticker (partial ``max_by`` aggregate)."""
    last = F.max_by(F.struct("price_date", "close"), "price_date")
    return prices.groupBy("ticker").agg(last.alias("l")).select(
        "ticker", F.col("l.price_date").alias("latest_close_date"), F.col("l.close").alias("latest_close"))


def _pre_aggregates(interactions: DataFrame, until: str | None, with_ticker: bool):
    """(pair × day) counts and, when edges carry ``ticker``, (actor × ticker) counts — both
    from ONE grouping-sets aggregation, whose exchange the readers below share."""
    conflict = to_double("goldstein_scale") < 0
    if until is not None:
        conflict = conflict & (F.col("date") <= until)
    aggs = [F.count(F.lit(1)).alias("n"), F.count(F.when(conflict, F.lit(1))).alias("n_conflicts")]
    if not with_ticker:
        return interactions.groupBy("src", "dst", "date").agg(*aggs), None
    g = (interactions.groupingSets([["src", "dst", "date"], ["src", "ticker"]], "src", "dst", "date", "ticker")
         .agg(*aggs, F.grouping("ticker").alias("g_ticker")))
    pair_day = g.filter(F.col("g_ticker") == 1).select("src", "dst", "date", "n", "n_conflicts")
    ticks = g.filter(F.col("g_ticker") == 0).select(F.col("src").alias("actor"), "ticker", "n")
    return pair_day, ticks


def briefing_rows(interactions: DataFrame, as_of: str, days: int = 1, threshold: float = 3.0,
                  until: str | None = None, k: int = 3, prices: DataFrame | None = None) -> DataFrame:
    """One row per actor. When the edges carry ``ticker`` and ``prices`` are given, it also
    carries the actor's most-linked ticker and that ticker's latest close."""
    with_ticker = prices is not None and "ticker" in interactions.columns
    pd_, ticks = _pre_aggregates(interactions, until, with_ticker)
    pairs = pd_.groupBy("src", "dst").agg(F.sum("n").alias("n"))
    degree = pairs.groupBy(F.col("src").alias("actor")).agg(F.sum("n").alias("n_interactions"))
    daily = pd_.filter(F.col("n_conflicts") > 0).select("src", "dst", "date",
                                                        F.col("n_conflicts").alias("daily_count"))
    alerts = score_pairs(daily, as_of, days, threshold).groupBy(F.col("src").alias("actor")).agg(
        F.count(F.when(F.col("is_anomaly"), F.lit(1))).alias("n_alerts"),
        F.max("z_score").alias("max_conflict_z"))
    out = (degree.join(top_counterparties(pairs, k), "actor", "left")
           .join(alerts, "actor", "left")
           .withColumn("n_alerts", F.coalesce(F.col("n_alerts"), F.lit(0)).cast("bigint")))
    text = F.concat(F.col("actor"), F.lit(": "), F.col("n_interactions").cast("string"),
                    F.lit(" interactions; top counterparties: "), F.coalesce(F.col("top_counterparties"), F.lit("none")),
                    F.lit("; conflict alerts: "), F.col("n_alerts").cast("string"))
    out = out.withColumn("briefing", text)
    if ticks is not None:
        out = (out.join(top_ticker(ticks), "actor", "left")
               .join(latest_close(prices), F.col("top_ticker") == F.col("ticker"), "left").drop("ticker"))
    return out
