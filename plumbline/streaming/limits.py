"""API calls as a stream: window counts and verdicts in arrival order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline import fixed_values as fv
from plumbline.functions.keys import retry_seconds, window_index
from plumbline.operators import limits, ranking
from plumbline.session import stage
from plumbline.streaming.store import BatchStore, KeyedLog

COUNTS = "subject string, window_index bigint, n bigint"
WINDOWS = COUNTS + ", expires_ms bigint"
CLOCK = "name string, now_ms bigint"
VERDICTS = "call_id bigint, subject string, nth bigint, ok boolean, retry_after_sec bigint"
LATE = "call_id bigint, subject string, window_index bigint"


def window_step(store: BatchStore, seconds: int = fv.RATE_WINDOW_SECONDS):
    """Count the calls of each micro-batch per subject and window, however late they come."""

    def step(batch: DataFrame, number: int) -> None:
        counts = limits.window_counts(batch, seconds).withColumnRenamed("calls", "n")
        store.write("windows", number, counts.select("subject", "window_index", "n"))

    return step


def window_totals(store: BatchStore) -> DataFrame:
    """Calls per subject and window over all micro-batches so far."""
    return store.read("windows", COUNTS).groupBy("subject", "window_index").agg(F.sum("n").alias("calls"))


def live_windows(store: BatchStore, width: int = 8, buckets: int = 64) -> KeyedLog:
    """The limiter's state: the calls so far of each window that has not expired."""
    return KeyedLog(store, "counts", WINDOWS, ["subject", "window_index"], expires="expires_ms", width=width, buckets=buckets)


def verdict_step(
    store: BatchStore, seconds: int = fv.RATE_WINDOW_SECONDS, limit: int = fv.RATE_LIMIT,
    grace_windows: int = 10, width: int = 8, buckets: int = 64,
):
    """Number each call of its window after the counts of earlier batches; rejected calls count too.

    The clock is the newest call so far. A window that ended more than ``grace_windows`` before it has expired: its
    count is swept and no longer read, so the state holds live windows only. Calls late within the grace go into
    their own window with the count that it has reached. A call of an expired window is let through, as its count
    starts anew there, and is listed in the side table ``late``.

    A subject that floods one window of a batch is spread over tasks (see ``ranking``).
    """
    counts, clock = live_windows(store, width, buckets), KeyedLog(store, "clock", CLOCK, ["name"], width=width, buckets=1)
    length = seconds * 1000

    def step(batch: DataFrame, number: int) -> None:
        ts = F.col("ts")
        calls = stage(batch.withColumn("window_index", window_index(ts, seconds)))
        known = clock.read(number).first()
        horizon = known.now_ms - grace_windows * length if known else None
        end = (F.col("window_index") + 1) * F.lit(length)
        late = F.lit(False) if horizon is None else end < horizon
        live = calls.filter(~late)
        earlier = counts.read(number, counts.touched(live), horizon).select("subject", "window_index", F.col("n").alias("before"))
        numbered = ranking.row_number(live, ["subject", "window_index"], [ts, F.col("call_id")], "nth").join(
            earlier, ["subject", "window_index"], "left")
        nth = F.col("nth") + F.coalesce("before", F.lit(0))
        ok = nth <= limit
        verdicts = numbered.select(
            "call_id", "subject", nth.alias("nth"), ok.alias("ok"),
            F.when(ok, 0).otherwise(retry_seconds(ts, seconds)).cast("long").alias("retry_after_sec"))
        swept = calls.filter(late)
        store.write("verdicts", number, verdicts.unionByName(swept.select(
            "call_id", "subject", F.lit(None).cast("long").alias("nth"), F.lit(True).alias("ok"), F.lit(0).cast("long").alias("retry_after_sec"))))
        store.write("late", number, swept.select("call_id", "subject", "window_index"))
        fresh = live.groupBy("subject", "window_index").agg(F.count(F.lit(1)).alias("n")).join(earlier, ["subject", "window_index"], "left")
        counts.write(number, fresh.select(
            "subject", "window_index", (F.col("n") + F.coalesce("before", F.lit(0))).alias("n"), end.alias("expires_ms")), horizon=horizon)
        newest = calls.agg(F.max(F.unix_millis(ts.cast("timestamp"))).alias("now_ms")).select(
            F.lit("clock").alias("name"), F.greatest("now_ms", F.lit(known.now_ms if known else None).cast("long")).alias("now_ms"))
        clock.write(number, newest.filter("now_ms IS NOT NULL"))

    return step
