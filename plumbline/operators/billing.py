"""Billing events: idempotent ledger, subscription state and entitlements."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline import fixed_values as fv

SUBSCRIPTION = (
    "id string, status string, current_period_end bigint, items array<struct<price:struct<id:string>>>"
)


def first_deliveries(events: DataFrame) -> DataFrame:
    """The first delivery of every event id; replays are no-ops."""
    row = F.struct(*[c for c in events.columns if c != "id"])
    return events.groupBy("id").agg(F.min_by(row, "arrival_seq").alias("e")).select("id", "e.*")


def subscription_patches(events: DataFrame) -> DataFrame:
    """Events that carry a subscription: id, status, first price and period end."""
    parsed = F.explode(F.array(F.from_json("subscription", SUBSCRIPTION)))
    return (
        events.filter(F.col("type").isin(fv.BILLING_EVENT_TYPES) & F.col("subscription").isNotNull())
        .select("*", parsed.alias("s"))
        .filter(F.col("customer_id").isNotNull() & F.col("s.id").isNotNull())
        .select(
            "id", "type", "customer_id", "arrival_seq", "created", F.col("s.id").alias("subscription_id"),
            F.col("s.status").alias("status"), F.try_element_at("s.items", F.lit(1))["price"]["id"].alias("price_id"),
            F.timestamp_seconds("s.current_period_end").cast("timestamp_ntz").alias("current_period_end"),
        )
    )


def last_patches(events: DataFrame, order_by: str = "arrival_seq") -> DataFrame:
    """The last write per customer as struct ``p``, with its arrival."""
    patch = F.struct("subscription_id", "status", "price_id", "current_period_end")
    order = F.struct(order_by, "arrival_seq")
    return (
        subscription_patches(first_deliveries(events))
        .groupBy(F.col("customer_id").alias("stripe_customer_id"))
        .agg(F.max_by(patch, order).alias("p"), F.max_by("arrival_seq", order).alias("arrival_seq"))
    )


def apply_patches(subscriptions: DataFrame, last: DataFrame) -> DataFrame:
    """Lay each customer's patch ``p`` over its row; customers without one stay as they are."""
    written = F.col("p").isNotNull()
    pick = lambda new, old: F.when(written, F.col(f"p.{new}")).otherwise(F.col(old))
    return subscriptions.join(last.select("stripe_customer_id", "p"), "stripe_customer_id", "left").select(
        "user_id", "stripe_customer_id",
        pick("subscription_id", "stripe_subscription_id").alias("stripe_subscription_id"),
        pick("status", "status").alias("status"), pick("price_id", "price_id").alias("price_id"),
        pick("current_period_end", "current_period_end").alias("current_period_end"),
    )


def billing_state(events: DataFrame, subscriptions: DataFrame, order_by: str = "arrival_seq") -> DataFrame:
    """Subscriptions after the events: the last write per customer wins, by arrival or by creation time.

    Unknown customers have no row to update and are dropped.
    """
    return apply_patches(subscriptions, last_patches(events, order_by))


def unknown_customers(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Events whose customer has no row: kept aside, never silently lost."""
    known = subscriptions.select(F.col("stripe_customer_id").alias("customer_id"))
    return subscription_patches(first_deliveries(events)).join(known, "customer_id", "left_anti")


def entitlements(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.withColumns(
        {
            "active": F.col("status").isin(fv.ACTIVE_STATUSES),
            "billing_issue": F.col("status").isin(fv.DUNNING_STATUSES),
        }
    )


def with_entitlement(rows: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Adds ``active`` by user; users without a subscription are inactive."""
    flags = entitlements(subscriptions).select("user_id", "active")
    return rows.join(flags, "user_id", "left").withColumn("active", F.coalesce("active", F.lit(False)))
