"""Billing events as a stream: a ledger that gives failed events back, and subscription state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from plumbline.operators import billing
from plumbline.session import stage
from plumbline.streaming.store import BatchStore, KeyedLog

LEDGER = "id string, type string, arrival_seq bigint"
PATCHES = (
    "stripe_customer_id string, subscription_id string, status string, price_id string, current_period_end timestamp_ntz, "
    "arrival_seq bigint"
)


def unseen(batch: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the ledger lacks.

    The ledger is the big side. Cutting it to the batch's keys first lets the planner broadcast the
    batch when it is small, so the ledger is scanned by key columns only and not shuffled.
    """
    hit = seen.select(*keys).join(batch.select(*keys).distinct(), keys, "left_semi").distinct()
    return batch.join(hit, keys, "left_anti")


def event_ledger(store: BatchStore, width: int = 8, buckets: int = 64) -> KeyedLog:
    """Handled events by id; an event whose handler failed is marked as gone, so its id can be taken again."""
    return KeyedLog(store, "ledger", LEDGER, ["id"], width=width, buckets=buckets)


def latest_patches(store: BatchStore, width: int = 8, buckets: int = 64) -> KeyedLog:
    """The last write per customer, by arrival."""
    return KeyedLog(store, "patches", PATCHES, ["stripe_customer_id"], version="arrival_seq", width=width, buckets=buckets)


def attempts(deliveries: DataFrame, handler: Callable[[DataFrame], DataFrame] | None) -> tuple[DataFrame, DataFrame | None]:
    """Handled events, and the last failed attempt of those that no delivery of the batch brought through.

    The first delivery of each id is tried. Where the handler fails, its claim is released and the next delivery of
    the same batch is tried, and so on: as many rounds as an id has failing deliveries in one batch.
    """
    tries = stage(billing.first_deliveries(deliveries))
    if handler is None:
        return tries, None
    handled, failed = None, None
    while True:
        bad = stage(handler(tries).select("id").distinct())
        good, lost = tries.join(bad, "id", "left_anti"), tries.join(bad, "id", "left_semi")
        handled = good if handled is None else handled.unionByName(good)
        failed = lost if failed is None else failed.unionByName(lost)
        rest = deliveries.join(lost.select("id", F.col("arrival_seq").alias("tried")), "id").filter("arrival_seq > tried").drop("tried")
        tries = stage(billing.first_deliveries(rest))
        if tries.isEmpty():
            last = failed.groupBy("id").agg(F.max_by("type", "arrival_seq").alias("type"), F.max("arrival_seq").alias("arrival_seq"))
            return handled, last.join(handled.select("id"), "id", "left_anti")


def billing_step(
    store: BatchStore, subscriptions: DataFrame, handler: Callable[[DataFrame], DataFrame] | None = None, width: int = 8,
    buckets: int = 64,
):
    """Micro-batch step: deliveries of ids that the ledger lacks are handled, recorded, and patch subscriptions.

    ``handler(events)`` does the work and gives the ids for which it failed: these are released and not applied, so a
    later delivery is handled. Only what a batch changes is written: its ledger rows and the patched customers.
    Patches of unknown customers go to the side table ``unknown``.
    """
    ledger, patches = event_ledger(store, width, buckets), latest_patches(store, width, buckets)

    def step(batch: DataFrame, number: int) -> None:
        rows = stage(batch)
        taken = ledger.read(number, ledger.touched(rows))
        handled, failed = attempts(unseen(rows, taken, ["id"]), handler)
        kept = store.write("fresh", number, handled)
        claims = kept.select("id", "type", "arrival_seq", F.lit(False).alias("released"))
        if failed is not None:
            claims = claims.unionByName(failed.select("id", "type", "arrival_seq", F.lit(True).alias("released")))
        ledger.write(number, claims, gone=F.col("released"))
        store.write("unknown", number, billing.unknown_customers(kept, subscriptions))
        last = billing.last_patches(kept).select("stripe_customer_id", "p.*", "arrival_seq")
        patches.write(number, last.join(subscriptions.select("stripe_customer_id"), "stripe_customer_id", "left_semi"))

    return step


def subscription_state(store: BatchStore, subscriptions: DataFrame) -> DataFrame:
    """Subscriptions with the newest patch of each customer laid over them."""
    names = ["subscription_id", "status", "price_id", "current_period_end"]
    return billing.apply_patches(
        subscriptions, latest_patches(store).read().select("stripe_customer_id", F.struct(*names).alias("p")))
