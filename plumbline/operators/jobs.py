"""Scan jobs: idempotent creation, supersession, state from an event log, backlog and fair order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline import fixed_values as fv
from plumbline.functions.keys import lease_expires_at, retry_ready_at
from plumbline.operators import ranking
from plumbline.session import stage

REF_KEYS = ["installation_id", "repo_full_name", "ref", "is_pull_request"]


def jobs_from_events(requests: DataFrame) -> DataFrame:
    """One job per (repo, commit) for ever: the first arrival wins, push or pull request alike."""
    row = F.struct(*[c for c in requests.columns if c not in ("repo_id", "head_sha")])
    first = requests.groupBy("repo_id", "head_sha").agg(F.min_by(row, "seq").alias("j"))
    return first.select("repo_id", "head_sha", "j.*")


def next_other_commit(arrivals: DataFrame, bound: int = ranking.BOUND) -> DataFrame:
    """``superseded_by(seq, head_sha)`` of every arrival: the next arrival of its ref with another commit.

    Runs over ALL arrivals, redelivered ones included. A ref with more than ``bound`` of them does not end up in a
    single task. The two ordered passes read their input twice, so it is staged.
    """
    order = [F.col("seq")]
    hot = ranking.hot_keys(arrivals, REF_KEYS, bound)
    here = F.struct("seq", "head_sha")
    stepped = stage(ranking.last_before(arrivals, REF_KEYS, order, F.col("head_sha"), "__previous", hot=hot))
    change = F.when(~F.col("head_sha").eqNullSafe(F.col("__previous")), here)
    return ranking.first_after(stepped, REF_KEYS, order, change, "superseded_by", hot=hot).drop("__previous")


def supersede(
    arrivals: DataFrame, claims: DataFrame | None = None, ignore_redelivery: bool = False, bound: int = ranking.BOUND
) -> DataFrame:
    """Jobs with the arrival that closed them while still queued.

    ``claims(repo_id, head_sha, claim_seq)`` protects jobs claimed before that arrival. With
    ``ignore_redelivery`` (a deviation) a repeated delivery of an old commit closes nothing.
    """
    arrivals = stage(jobs_from_events(arrivals) if ignore_redelivery else arrivals)
    jobs = jobs_from_events(next_other_commit(arrivals, bound))
    if claims is None:
        open_at = F.lit(True)
        joined = jobs
    else:
        first_claim = claims.groupBy("repo_id", "head_sha").agg(F.min("claim_seq").alias("__claimed"))
        joined = jobs.join(first_claim, ["repo_id", "head_sha"], "left")
        open_at = F.col("__claimed").isNull() | (F.col("superseded_by.seq") < F.col("__claimed"))
    closed = F.col("superseded_by").isNotNull() & open_at
    return joined.withColumns(
        {
            "status": F.when(closed, "done").otherwise("queued"),
            "closed_by_seq": F.when(closed, F.col("superseded_by.seq")),
            "note": F.when(closed, F.concat(F.lit("superseded by "), "superseded_by.head_sha")),
        }
    ).drop("superseded_by", "__claimed")


def superseded_counts(superseded: DataFrame) -> DataFrame:
    return (
        superseded.filter(F.col("closed_by_seq").isNotNull())
        .groupBy("closed_by_seq").agg(F.count(F.lit(1)).alias("closed"))
    )


def job_state(job_events: DataFrame) -> DataFrame:
    """State of every job from its append-only events: one aggregation, partial before the shuffle.

    Events: queued, claimed, check_opened, failed, done, superseded.
    """
    event, at = F.col("event"), F.struct("seq", "ts")
    moves = ["queued", "claimed", "failed", "done", "superseded"]
    error = (
        F.when(event == "failed", F.substring("error", 1, fv.JOB_ERROR_CHARS))
        .when(event == "superseded", F.concat(F.lit("superseded by "), "error"))
    )
    folded = job_events.groupBy("job_id").agg(
        F.min_by("installation_id", "seq").alias("installation_id"),
        F.min("ts").alias("created_at"),
        F.max_by(event, F.when(event.isin(moves), F.col("seq"))).alias("last"),
        F.max(F.when(event.isin(moves), at)).alias("moved"),
        F.max(F.when(event == "claimed", at)).alias("claim"),
        F.count_if(event == "claimed").alias("attempts"),
        F.min_by("check_run_id", F.when(event == "check_opened", F.col("seq"))).alias("check_run_id"),
        F.max(F.when(event.isin("failed", "done", "superseded"), F.struct("seq", error.alias("error")))).alias("err"),
    )
    dead = (F.col("last") == "failed") & (F.col("attempts") >= fv.MAX_ATTEMPTS)
    status = (
        F.when(F.col("last") == "claimed", "running").when(dead, "dead").when(F.col("last") == "failed", "error")
        .when(F.col("last").isin("done", "superseded"), "done").otherwise("queued")
    )
    return folded.select(
        "job_id", "installation_id", "created_at", status.alias("status"), "attempts",
        F.col("claim.ts").alias("claimed_at"),
        F.when(status.isin("done", "dead"), F.col("moved.ts")).alias("finished_at"),
        "check_run_id", F.col("err.error").alias("last_error"),
    )


def backlog(jobs: DataFrame, as_of: str) -> DataFrame:
    """Claimable jobs with their ``reason`` at a time; ``stuck`` ones are neither claimable nor dead."""
    now = F.lit(as_of).cast("timestamp_ntz")
    retryable = F.col("attempts") < fv.MAX_ATTEMPTS
    expired = lease_expires_at(F.col("claimed_at")) < now
    reason = (
        F.when(F.col("status") == "queued", "queued")
        .when(
            (F.col("status") == "error") & retryable & (retry_ready_at(F.col("claimed_at"), F.col("attempts")) < now),
            "retry",
        )
        .when((F.col("status") == "running") & expired, F.when(retryable, "lease_expired").otherwise("stuck"))
    )
    return jobs.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def claimable(jobs: DataFrame, as_of: str, excluded: DataFrame | None = None) -> DataFrame:
    """Backlog without stuck jobs and without the installations of ``excluded``."""
    ready = backlog(jobs, as_of).filter(F.col("reason") != "stuck")
    return ready if excluded is None else ready.join(excluded.select("installation_id"), "installation_id", "left_anti")


def next_claimable(jobs: DataFrame, as_of: str, limit: int = 1) -> DataFrame:
    """Oldest claimable jobs: a top-k, not a full sort."""
    return claimable(jobs, as_of).orderBy("created_at", "job_id").limit(limit)


def fair_order(ready: DataFrame, bound: int = ranking.BOUND) -> DataFrame:
    """``round`` of each job: at most one job per installation per round, oldest first."""
    return ranking.row_number(ready, ["installation_id"], [F.col("created_at"), F.col("job_id")], "round", bound)


def run_totals(job_events: DataFrame, keys) -> DataFrame:
    event = F.col("event")
    return job_events.groupBy(*keys).agg(
        F.count_if(event == "claimed").alias("claimed"), F.count_if(event == "done").alias("done"),
        F.count_if(event == "failed").alias("failed"),
    )
