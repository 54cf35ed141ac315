"""Fixed-window rate limits. Windows are aligned to the epoch; rejected calls still count."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline import fixed_values as fv
from plumbline.functions.keys import retry_seconds, window_end_millis, window_index
from plumbline.operators import ranking


def window_counts(calls: DataFrame, seconds: int = fv.RATE_WINDOW_SECONDS) -> DataFrame:
    """Calls per subject and window: the limiter's buckets."""
    ts = F.col("ts")
    return (
        calls.groupBy("subject", window_index(ts, seconds).alias("window_index"))
        .agg(F.count(F.lit(1)).alias("calls"))
        .withColumn("expires_ms", (F.col("window_index") + 1) * F.lit(seconds * 1000))
    )


def rate_limit(
    calls: DataFrame, seconds: int = fv.RATE_WINDOW_SECONDS, limit: int = fv.RATE_LIMIT, bound: int = ranking.BOUND
) -> DataFrame:
    """Verdict per call: the nth of its window, ``ok`` and the seconds until the next window.

    A subject that floods one window with more than ``bound`` calls is spread over tasks.
    """
    ts = F.col("ts")
    keyed = calls.withColumn("window_index", window_index(ts, seconds))
    numbered = ranking.row_number(keyed, ["subject", "window_index"], [ts, F.col("call_id")], "nth", bound)
    ok = F.col("nth") <= limit
    return numbered.withColumns(
        {"ok": ok, "retry_after_sec": F.when(ok, 0).otherwise(retry_seconds(ts, seconds)).cast("long")}
    )


def live_buckets(buckets: DataFrame, as_of_ms: int) -> DataFrame:
    """Buckets left by a sweep: those that have not expired."""
    return buckets.filter(F.col("expires_ms") >= as_of_ms)


def with_window_end(calls: DataFrame, seconds: int = fv.RATE_WINDOW_SECONDS) -> DataFrame:
    return calls.withColumn("window_end_ms", window_end_millis(F.col("ts"), seconds))
