"""Zero-filled 15-minute count baselines per event type.

The reference loops over types and materialises a dense series per type. Here all
types are handled by one aggregation. The sparse form never builds the spine: with
``N`` spine points and per-type sums ``S = Σn`` and ``Q = Σn²`` over the observed
in-range intervals, the zero-filled statistics are

    mean = S / N,   var = (N·Q − S²) / (N·(N − 1))

where the numerator is computed in exact decimal arithmetic, so the result equals the
dense computation without cancellation error.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions.text import metric_key
from eventide.functions.timefmt import STEP, STEP_SECONDS, aligned, n_points, ntz

MODEL_COLUMNS = ["metric_key", "mean", "std_dev", "total_occurrences"]


def interval_counts(events: DataFrame, cols: list[str], ts_col: str = "interval_ts") -> DataFrame:
    """Rows per ``(column, value, interval)`` for several type columns in one pass (A1, A2).

    ``unpivot`` turns each row into one row per type column (an ``Expand``), so the scan
    and the aggregation happen once; NULL values are dropped like a pandas group key.
    """
    long = (events.select(ts_col, *cols)
            .unpivot([ts_col], cols, "metric_col", "metric_val")
            .filter(F.col("metric_val").isNotNull()))
    return (long.groupBy("metric_col", "metric_val", ts_col).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("metric_key", metric_key("metric_col", "metric_val")))


def interval_counts_grouping_sets(events: DataFrame, cols: list[str], ts_col: str = "interval_ts") -> DataFrame:
    """Same result as :func:`interval_counts` written as ``GROUPING SETS ((c1, ts), (c2, ts), ...)``."""
    sets = [[F.col(c), F.col(ts_col)] for c in cols]
    g = events.groupingSets(sets, *[F.col(c) for c in cols], F.col(ts_col)).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"__g_{c}") for c in cols])
    which = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for c in reversed(cols):
        which = F.when(F.col(f"__g_{c}") == 0, F.lit(c)).otherwise(which)
        value = F.when(F.col(f"__g_{c}") == 0, F.col(c)).otherwise(value)
    return (g.select(which.alias("metric_col"), value.alias("metric_val"), ts_col, "n")
            .filter(F.col("metric_val").isNotNull())
            .withColumn("metric_key", metric_key("metric_col", "metric_val")))


def significant_types(counts: DataFrame, min_total: int) -> DataFrame:
    """Types whose count over the whole log is strictly above ``min_total`` (A3, A4)."""
    return (counts.groupBy("metric_key").agg(F.sum("n").cast("bigint").alias("total"))
            .filter(F.col("total") > F.lit(min_total)))


def _in_spine(counts: DataFrame, start: datetime, end: datetime, ts_col: str, step_seconds: int) -> DataFrame:
    ts = F.col(ts_col)
    return counts.filter((ts >= ntz(start)) & (ts <= ntz(end)) & aligned(ts, start, step_seconds))


def zero_filled_model(n: int) -> list[Column]:
    """The model columns from a key's ``s`` = Σ count and ``q`` = Σ count² over ``n`` spine points."""
    # sums of squares pass 64 bits at large volumes; 38 digits hold them, and s * s, exactly
    dec = "decimal(19,0)"
    num = F.lit(n).cast("decimal(9,0)") * F.col("q").cast("decimal(29,0)") - F.col("s").cast(dec) * F.col("s").cast(dec)
    var = num.cast("double") / F.lit(float(n) * float(n - 1)) if n > 1 else F.lit(None).cast("double")
    return [F.col("metric_key"), (F.col("s") / F.lit(float(n))).alias("mean"),
            F.sqrt(F.greatest(var, F.lit(0.0))).alias("std_dev"), F.col("s").alias("total_occurrences")]


def baseline_sparse(counts: DataFrame, significant: DataFrame, start: datetime, end: datetime,
                    ts_col: str = "interval_ts", step_seconds: int = STEP_SECONDS) -> DataFrame:
    """Zero-filled mean / sample std / total per significant type without a spine."""
    n = n_points(start, end, step_seconds)
    if n < 1:
        raise ValueError("empty spine")
    sums = (_in_spine(counts, start, end, ts_col, step_seconds)
            .groupBy("metric_key")
            .agg(F.sum("n").cast("bigint").alias("s"), F.sum(F.col("n").cast("decimal(19,0)") * F.col("n")).cast("decimal(38,0)").alias("q")))
    return (significant.select("metric_key").join(sums, "metric_key", "left")
            .fillna(0, subset=["s", "q"])
            .select(*zero_filled_model(n)))


def sparse_model(counts: DataFrame, min_total: int, start: datetime, end: datetime,
                 ts_col: str = "interval_ts", step_seconds: int = STEP_SECONDS) -> DataFrame:
    """Significance test and zero-filled statistics in ONE aggregation over the counts.

    Per key: the whole-log total (for the strict ``> min_total`` test, A3/A4) and the
    in-spine sums ``S``, ``Q`` are conditional sums of the same group-by, so the counts
    are read once and no join is needed. Equal to
    ``baseline_sparse(counts, significant_types(counts, min_total), ...)``.
    """
    n = n_points(start, end, step_seconds)
    if n < 1:
        raise ValueError("empty spine")
    ts = F.col(ts_col)
    inside = (ts >= ntz(start)) & (ts <= ntz(end)) & aligned(ts, start, step_seconds)
    agg = (counts.groupBy("metric_key")
           .agg(F.sum("n").alias("total"),
                F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).cast("bigint").alias("s"),
                F.coalesce(F.sum(F.when(inside, F.col("n").cast("decimal(19,0)") * F.col("n"))), F.lit(0)).cast("decimal(38,0)").alias("q"))
           .filter(F.col("total") > F.lit(min_total)))
    return agg.select(*zero_filled_model(n))


def baseline_dense(counts: DataFrame, significant: DataFrame, start: datetime, end: datetime,
                   ts_col: str = "interval_ts", step: str = STEP) -> DataFrame:
    """The reference's formulation: a spine per significant type, left join, fill 0.

    The spine is generated per type (``explode(sequence)``), so its size is
    ``types × N`` and does not grow with the event volume.
    """
    spine = significant.select("metric_key", F.explode(F.sequence(ntz(start), ntz(end),
                                                                  F.expr(f"INTERVAL {step}"))).alias(ts_col))
    dense = (spine.join(counts.select("metric_key", ts_col, "n"), ["metric_key", ts_col], "left")
             .select("metric_key", F.coalesce(F.col("n"), F.lit(0)).alias("n")))
    return dense.groupBy("metric_key").agg(
        F.avg("n").alias("mean"), F.stddev_samp("n").alias("std_dev"),
        F.sum("n").cast("bigint").alias("total_occurrences"))


def build_baseline(events: DataFrame, cols: list[str], start: datetime, end: datetime,
                   min_total: int = 500, ts_col: str = "interval_ts", dense: bool = False) -> DataFrame:
    """Pass 2 as one job: counts → significant types → model rows."""
    counts = interval_counts(events, cols, ts_col)
    if dense:
        return baseline_dense(counts, significant_types(counts, min_total), start, end, ts_col)
    return sparse_model(counts, min_total, start, end, ts_col)


def running_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean and sample std per key with one point giving 0.0."""
    return df.groupBy(key).agg(
        F.count(F.col(value)).alias("n"), F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_dev"))
