"""Repository events: parsing, routing, scan requests and installation lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline import fixed_values as fv

PAYLOAD = (
    "action string, installation struct<id:bigint>, "
    "repositories_removed array<struct<id:bigint,full_name:string>>, "
    "ref string, after string, deleted boolean, "
    "repository struct<id:bigint,full_name:string,default_branch:string>, "
    "pull_request struct<head:struct<sha:string,ref:string,repo:struct<id:bigint>>>"
)


def parse_events(events: DataFrame) -> DataFrame:
    """``payload`` JSON → sparse struct ``p``; events without an installation id are dropped.

    The struct comes out of a generator, so it is parsed once. As a plain column it would be parsed again
    for every condition and field the optimizer moves below it.
    """
    parsed = events.select("*", F.explode(F.array(F.from_json("payload", PAYLOAD))).alias("p")).drop("payload")
    return parsed.filter(F.col("p.installation.id").isNotNull()).withColumn("installation_id", F.col("p.installation.id"))


def _present(name: str):
    return F.coalesce(F.col(name) != "", F.lit(False))


def scan_requests(events: DataFrame, installations: DataFrame) -> DataFrame:
    """Pushes to the default branch and same-repo pull requests of known, live installations."""
    parsed = parse_events(events)
    repo = F.coalesce(F.col("p.repository.id") != 0, F.lit(False)) & _present("p.repository.full_name")
    zero = F.col("p.after").rlike(fv.ZERO_SHA_PATTERN)
    push = (
        (F.col("event") == "push") & repo & _present("p.repository.default_branch")
        & ~F.coalesce("p.deleted", F.lit(False)) & _present("p.after") & ~F.coalesce(zero, F.lit(False))
        & F.coalesce(
            F.col("p.ref") == F.concat(F.lit("refs/heads/"), "p.repository.default_branch"), F.lit(False)
        )
    )
    head = "p.pull_request.head"
    pull = (
        (F.col("event") == "pull_request") & F.coalesce(F.col("p.action").isin(fv.PULL_REQUEST_ACTIONS), F.lit(False))
        & repo & _present(f"{head}.sha") & _present(f"{head}.ref")
        & F.coalesce(F.col(f"{head}.repo.id") == F.col("p.repository.id"), F.lit(False))
    )
    is_pull = F.col("event") == "pull_request"
    wanted = parsed.filter(push | pull).select(
        "seq", "ts", "installation_id", F.col("p.repository.full_name").alias("repo_full_name"),
        F.col("p.repository.id").alias("repo_id"),
        F.when(is_pull, F.col(f"{head}.sha")).otherwise(F.col("p.after")).alias("head_sha"),
        F.when(is_pull, F.col(f"{head}.ref")).otherwise(F.col("p.ref")).alias("ref"),
        is_pull.alias("is_pull_request"),
    )
    live = installations.filter(F.col("suspended_at").isNull()).select("installation_id", "user_id")
    return wanted.join(live, "installation_id")


def installation_state(installations: DataFrame, events: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """Installations after the events: deleted ones gone, suspension toggled, bindings overwrite the owner.

    ``bindings(seq, installation_id, user_id, account_login, account_type)`` come from the setup callback
    and clear a suspension. Only the last deletion, binding and toggle of an id matter, so the fold is one
    aggregation with a partial step.
    """
    parsed = parse_events(events).filter(F.col("event") == "installation")
    action = F.col("p.action")
    toggle = F.when(action == "suspend", F.col("ts"))
    folded = parsed.groupBy("installation_id").agg(
        F.max(F.when(action == "deleted", F.col("seq"))).alias("deleted_seq"),
        F.max(F.when(action.isin("suspend", "unsuspend"), F.struct("seq", toggle.alias("at")))).alias("toggle"),
    )
    columns = ["installation_id", "account_login", "account_type", "user_id", "suspended_at"]
    if bindings is None:
        joined = installations.select(*columns).join(folded, "installation_id", "left")
        bound_seq, exists = F.lit(-1), F.col("deleted_seq").isNull()
        owner = {c: F.col(c) for c in columns[:4]}
    else:
        fields = F.struct(
            "seq", F.coalesce("account_login", F.lit("unknown")).alias("account_login"),
            F.coalesce("account_type", F.lit("User")).alias("account_type"), "user_id",
        )
        bound = bindings.groupBy("installation_id").agg(F.max(fields).alias("b"))
        joined = (
            installations.select(*columns).join(bound, "installation_id", "full")
            .join(folded, "installation_id", "left")
        )
        bound_seq = F.coalesce("b.seq", F.lit(-1))
        exists = F.col("deleted_seq").isNull() | (bound_seq > F.col("deleted_seq"))
        owner = {"installation_id": F.col("installation_id")}
        for c in columns[1:4]:
            owner[c] = F.when(F.col("b").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(c))
    toggled = F.coalesce(F.col("toggle.seq") > bound_seq, F.lit(False))
    suspended = F.when(toggled, F.col("toggle.at")).when(bound_seq < 0, F.col("suspended_at"))
    return joined.filter(exists).select(
        *[expr.alias(name) for name, expr in owner.items()], suspended.alias("suspended_at")
    )


def remaining_setups(setups: DataFrame, events: DataFrame) -> DataFrame:
    """Setups left after uninstalls and removed repositories: two anti joins on small key sets."""
    parsed = parse_events(events)
    gone = (
        parsed.filter((F.col("event") == "installation") & (F.col("p.action") == "deleted"))
        .select("installation_id").distinct()
    )
    removed = (
        parsed.filter((F.col("event") == "installation_repositories") & (F.col("p.action") == "removed"))
        .select("installation_id", F.explode("p.repositories_removed.full_name").alias("repo_full_name"))
        .filter(F.coalesce(F.col("repo_full_name") != "", F.lit(False))).distinct()
    )
    return setups.join(gone, "installation_id", "left_anti").join(
        removed, ["installation_id", "repo_full_name"], "left_anti"
    )
