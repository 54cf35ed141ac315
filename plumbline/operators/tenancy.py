"""Keys, ownership, account removal and unique-key audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.keys import bearer_token, token_hash

# Tables that go with a user; shared tables (cache, rate limits, event ledger) stay.
USER_TABLES = [
    "accounts", "sessions", "subscriptions", "api_keys", "scans", "installations", "repo_setups", "jobs",
    "provider_connections",
]


def resolve_keys(calls: DataFrame, api_keys: DataFrame) -> DataFrame:
    """Calls whose bearer token belongs to a live key; only the hash of a token is compared."""
    hashed = calls.withColumn("key_hash", token_hash(bearer_token(F.col("header")))).drop("header")
    live = api_keys.filter(F.col("revoked_at").isNull()).select("key_hash", F.col("id").alias("api_key_id"), "user_id")
    return hashed.filter(F.col("key_hash").isNotNull()).join(live, "key_hash").drop("key_hash")


def last_used(api_keys: DataFrame, uses: DataFrame) -> DataFrame:
    """Keys with the latest use time; ``uses`` comes from ``resolve_keys``."""
    latest = uses.groupBy(F.col("api_key_id").alias("id")).agg(F.max("ts").alias("__used"))
    return (
        api_keys.join(latest, "id", "left")
        .withColumn("last_used_at", F.coalesce("__used", "last_used_at")).drop("__used")
    )


def key_listing(api_keys: DataFrame) -> DataFrame:
    """Display columns only, never the hash."""
    return api_keys.select("user_id", "id", "name", "key_prefix", "created_at", "last_used_at", "revoked_at")


def newest_keys(api_keys: DataFrame) -> DataFrame:
    return key_listing(api_keys).orderBy("user_id", F.col("created_at").desc(), "id")


def revoke(api_keys: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """Revoke a user's own keys; a key revoked earlier keeps its time."""
    asked = requests.select("user_id", "id").distinct().withColumn("__asked", F.lit(True))
    at = F.when(F.col("__asked"), F.lit(now).cast("timestamp_ntz"))
    return (
        api_keys.join(asked, ["user_id", "id"], "left")
        .withColumn("revoked_at", F.coalesce("revoked_at", at)).drop("__asked")
    )


def purge(tables: Mapping[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    """Every user table without the rows of ``users``; other tables pass through untouched."""
    gone = users.select("user_id").distinct()
    return {
        name: df.join(gone, "user_id", "left_anti") if name in USER_TABLES else df for name, df in tables.items()
    }


def null_missing_keys(rows: DataFrame, api_keys: DataFrame, column: str = "api_key_id") -> DataFrame:
    """Set a key reference to null where the key is gone."""
    present = api_keys.select(F.col("id").alias(column), F.lit(True).alias("__present"))
    return (
        rows.join(present, column, "left")
        .withColumn(column, F.when(F.col("__present"), F.col(column))).drop("__present")
    )


def owned(requests: DataFrame, installations: DataFrame) -> DataFrame:
    """Requests for an installation that is bound to the requesting user."""
    return requests.join(installations, ["installation_id", "user_id"], "left_semi")


def connected(requests: DataFrame, repos: DataFrame) -> DataFrame:
    """Requests for a repository among the user's connected ones."""
    return requests.join(repos, ["user_id", "repo_full_name"], "left_semi")


def without_setup(repos: DataFrame, setups: DataFrame) -> DataFrame:
    return repos.join(setups, ["user_id", "repo_full_name"], "left_anti")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Audit of a unique key: values that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def connected_installations(installations: DataFrame) -> DataFrame:
    return installations.withColumn("suspended", F.col("suspended_at").isNotNull()).drop("suspended_at")
