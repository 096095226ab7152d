"""Event signals fused with daily prices (J11, E1): same-day equi-join and an exact as-of join.

As-of join without a range join: the time axis is cut into buckets (months by default).
Inside a bucket the latest right row at or before each left row comes from one ordered
window over ``(key, bucket)``; a left row with nothing earlier in its bucket takes the
last right row of the closest earlier bucket, found on a per-key table of one row per
bucket. Rows per window partition are bounded by the bucket width, not by the key's
total volume, and the result equals a row-by-row backward search.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.timefmt import parse_day


def month_bucket(ts: Column) -> Column:
    return F.date_trunc("month", ts).cast("date")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
              right_cols: list[str], bucket: Callable[[Column], Column] = month_bucket) -> DataFrame:
    """For every left row, the latest right row with the same key and ``right_ts <= left_ts``.

    Unmatched left rows keep NULLs (left as-of join). ``right_ts`` is returned as well.
    Each input is read twice (timeline and bucket summary): land expensive ones first.
    """
    lcols = left.columns
    l = (left.withColumn("__b", bucket(F.col(left_ts)))
         .withColumn("__l", F.struct(*[F.col(c) for c in lcols])))
    # a NULL key or time on the right matches nothing, as in an equi-join
    r = (right.select(F.col(key), F.col(right_ts), *right_cols)
         .filter(F.col(key).isNotNull() & F.col(right_ts).isNotNull())
         .withColumn("__b", bucket(F.col(right_ts)))
         .withColumn("__p", F.struct(F.col(right_ts).alias("__rts"), *[F.col(c) for c in right_cols])))
    no_p = F.lit(None).cast(r.schema["__p"].dataType)
    no_l = F.lit(None).cast(l.schema["__l"].dataType)

    # 1. inside a bucket: one ordered timeline of right rows (kind 0) then left rows (kind 1);
    #    left rows travel whole in a struct, so no row id or self-join is needed
    lt = l.select(key, "__b", F.col(left_ts).alias("__t"), F.lit(1).alias("__kind"), no_p.alias("__p"), "__l")
    rt = r.select(key, "__b", F.col(right_ts).alias("__t"), F.lit(0).alias("__kind"), "__p", no_l.alias("__l"))
    upto = Window.unboundedPreceding, Window.currentRow
    w = Window.partitionBy(key, "__b").orderBy("__t", "__kind").rowsBetween(*upto)
    inside = (lt.unionByName(rt).withColumn("__m", F.last("__p", ignorenulls=True).over(w))
              .filter(F.col("__kind") == 1).select(key, "__b", "__l", "__m"))

    # 2. across buckets: the last right row of each (key, bucket), carried to later buckets;
    #    a left bucket sorts before the right summary of the same bucket (strictly earlier only)
    last_in_bucket = (r.groupBy(key, "__b").agg(F.max_by("__p", F.col(right_ts)).alias("__p"))
                      .withColumn("__kind", F.lit(1)))
    left_buckets = l.select(key, "__b").distinct().withColumn("__kind", F.lit(0)).withColumn("__p", no_p)
    wb = Window.partitionBy(key).orderBy("__b", "__kind").rowsBetween(*upto)
    carry = (left_buckets.unionByName(last_in_bucket.select(key, "__b", "__kind", "__p"))
             .withColumn("__c", F.last("__p", ignorenulls=True).over(wb))
             .filter(F.col("__kind") == 0).select(key, "__b", "__c"))

    joined = (inside.join(carry, [key, "__b"], "left")
              .withColumn("__r", F.coalesce(F.col("__m"), F.col("__c"))))
    return joined.select(*[F.col(f"__l.{c}").alias(c) for c in lcols], F.col("__r.__rts").alias(right_ts),
                         *[F.col(f"__r.{c}").alias(c) for c in right_cols])


def event_signal(rows: DataFrame, key: str | None = None) -> DataFrame:
    """Daily event signal: events and conflicts per day (and per ``key`` when given)."""
    day = parse_day("sqldate").alias("event_date")
    conflict = F.col("goldstein_scale").try_cast("double") < 0
    keys = [F.col(key)] if key else []
    return rows.groupBy(*keys, day).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count(F.when(conflict, F.lit(1))).alias("n_conflicts"))


def prices_with_events(prices: DataFrame, signal: DataFrame, key: str = "ticker") -> DataFrame:
    """Trading days joined with the same day's event signal (equi-join on key and date)."""
    s = signal.withColumnRenamed("event_date", "price_date")
    return prices.join(s, [key, "price_date"])


def events_with_latest_price(signal: DataFrame, prices: DataFrame, key: str = "ticker") -> DataFrame:
    """Each event day with the latest close on or before it (as-of, NULL when none)."""
    return asof_join(signal, prices, key, "event_date", "price_date", ["close"])
