"""Scan requests as a stream: one job per commit, queued jobs closed by newer commits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from plumbline.operators import jobs as jb, ranking
from plumbline.session import stage
from plumbline.streaming.ledger import unseen
from plumbline.streaming.store import BatchStore, KeyedLog

REQUEST = (
    "repo_id bigint, head_sha string, seq bigint, installation_id bigint, repo_full_name string, ref string, "
    "is_pull_request boolean, user_id bigint"
)
JOBS = REQUEST + ", closed_by_seq bigint, note string"
COMMIT = ["repo_id", "head_sha"]


def all_jobs(store: BatchStore, width: int = 8, buckets: int = 64) -> KeyedLog:
    """One row per commit for ever, rewritten when the job is closed."""
    return KeyedLog(store, "jobs", JOBS, COMMIT, width=width, buckets=buckets)


def open_jobs(store: BatchStore, width: int = 8, buckets: int = 64) -> KeyedLog:
    """Jobs that a later commit can still close, dealt by ref; closed and claimed ones are gone."""
    return KeyedLog(store, "open", REQUEST, ["seq", *jb.REF_KEYS], bucket_by=jb.REF_KEYS, width=width, buckets=buckets)


def jobs_step(
    store: BatchStore, bound: int = ranking.BOUND, claims: Callable[[], DataFrame] | None = None, width: int = 8, buckets: int = 64,
):
    """New commits become jobs; every arrival, redelivered or not, closes older queued jobs of its ref.

    ``claims`` gives the present (repo_id, head_sha, claim_seq): a job claimed before the arrival that would
    close it is running or done, and stays as it is. Arrivals come in the order of ``seq`` from batch to batch, so a
    job claimed before the last arrival of a batch can never be closed.
    """
    jobs, waiting = all_jobs(store, width, buckets), open_jobs(store, width, buckets)
    columns = [c.split()[0] for c in REQUEST.split(", ")]

    def step(batch: DataFrame, number: int) -> None:
        arrivals = stage(batch.select(*columns))
        known = jobs.read(number, jobs.touched(arrivals))
        created = stage(unseen(jb.jobs_from_events(arrivals).select(*columns), known, COMMIT))
        # Only queued jobs of the refs that arrived can be closed now.
        refs = arrivals.select(*jb.REF_KEYS).distinct()
        older = stage(waiting.read(number, waiting.touched(arrivals)).select(*columns).join(refs, jb.REF_KEYS, "left_semi"))
        after = jb.next_other_commit(older.unionByName(arrivals), bound).filter(F.col("superseded_by").isNotNull())
        now_open = older.unionByName(created)
        closing = now_open.join(after.select("seq", "superseded_by"), "seq", "left")
        if claims is not None:
            first = claims().groupBy(*COMMIT).agg(F.min("claim_seq").alias("claimed"))
            closing = closing.join(first, COMMIT, "left")
        else:
            closing = closing.withColumn("claimed", F.lit(None).cast("long"))
        closes = F.col("superseded_by").isNotNull() & (F.col("claimed").isNull() | (F.col("superseded_by.seq") < F.col("claimed")))
        last = arrivals.agg(F.max("seq")).first()[0]
        decided = stage(closing.select(
            *columns, F.when(closes, F.col("superseded_by.seq")).alias("closed_by_seq"),
            F.when(closes, F.concat(F.lit("superseded by "), "superseded_by.head_sha")).alias("note"),
            (closes | F.coalesce(F.col("claimed") <= F.lit(last), F.lit(False))).alias("settled"),
        ))
        changed = decided.filter("closed_by_seq IS NOT NULL").unionByName(
            decided.filter("closed_by_seq IS NULL").join(created.select("seq"), "seq", "left_semi"))
        jobs.write(number, changed.drop("settled"))
        fresh = decided.join(created.select("seq"), "seq", "left_semi").filter("NOT settled")
        gone = decided.join(created.select("seq"), "seq", "left_anti").filter("settled")
        waiting.write(number, fresh.unionByName(gone).select(*columns, "settled"), gone=F.col("settled"))

    return step


def jobs_with_status(store: BatchStore) -> DataFrame:
    return all_jobs(store).read().withColumn("status", F.when(F.col("closed_by_seq").isNotNull(), "done").otherwise("queued"))
