"""Queries over repository events, jobs and rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import keys as k, paths
from plumbline.operators import events as ev, jobs as jb, limits
from plumbline.plans import oracle as o
from plumbline.plans import query
from plumbline.session import stage

_AS_OF = "2024-01-30 12:00:00"
_REQUEST_COLUMNS = [
    "seq", "installation_id", "repo_full_name", "repo_id", "head_sha", "ref", "is_pull_request", "user_id",
]


@query("scan_requests", f"WITH {o.REQUESTS} SELECT {', '.join(_REQUEST_COLUMNS)} FROM requests")
def _requests(t):
    return ev.scan_requests(t.repo_events(), t.installations()).select(*_REQUEST_COLUMNS)


@query(
    "jobs_from_events",
    f"WITH {o.REQUESTS} SELECT {', '.join(_REQUEST_COLUMNS)} FROM requests "
    "QUALIFY row_number() OVER (PARTITION BY repo_id, head_sha ORDER BY seq) = 1",
)
def _jobs(t):
    return jb.jobs_from_events(ev.scan_requests(t.repo_events(), t.installations())).select(*_REQUEST_COLUMNS)


_SUPERSEDED = f"""WITH {o.REQUESTS}, first AS (SELECT * FROM requests QUALIFY row_number() OVER (PARTITION BY repo_id, head_sha ORDER BY seq) = 1),
closer AS (SELECT f.seq, min(a.seq) AS by_seq FROM first f JOIN requests a ON a.installation_id = f.installation_id
    AND a.repo_full_name = f.repo_full_name AND a.ref = f.ref AND a.is_pull_request = f.is_pull_request
    AND a.seq > f.seq AND a.head_sha <> f.head_sha GROUP BY f.seq)"""
_CLAIMED = "claims AS (SELECT seq, seq + 400 AS claim_seq FROM first WHERE seq % 2 = 0)"


def claims_of(requests):
    """Every other job is claimed 400 places after it came."""
    first = jb.jobs_from_events(requests)
    return first.filter(F.col("seq") % 2 == 0).select("repo_id", "head_sha", (F.col("seq") + 400).alias("claim_seq"))


@query(
    "superseded_jobs",
    f"""{_SUPERSEDED}, {_CLAIMED} SELECT f.seq, f.repo_id, f.head_sha,
    CASE WHEN by_seq < coalesce(claim_seq, 1000000000000) THEN 'done' ELSE 'queued' END AS status,
    CASE WHEN by_seq < coalesce(claim_seq, 1000000000000) THEN by_seq END AS closed_by_seq,
    CASE WHEN by_seq < coalesce(claim_seq, 1000000000000) THEN 'superseded by ' || r.head_sha END AS note
    FROM first f LEFT JOIN closer c ON c.seq = f.seq LEFT JOIN requests r ON r.seq = c.by_seq LEFT JOIN claims l ON l.seq = f.seq""",
)
def _superseded(t):
    requests = stage(ev.scan_requests(t.repo_events(), t.installations()))
    return jb.supersede(requests, claims_of(requests)).select(
        "seq", "repo_id", "head_sha", "status", "closed_by_seq", "note"
    )


@query(
    "superseded_counts",
    f"{_SUPERSEDED} SELECT by_seq AS closed_by_seq, count(*) AS closed FROM closer GROUP BY by_seq",
)
def _superseded_counts(t):
    return jb.superseded_counts(jb.supersede(ev.scan_requests(t.repo_events(), t.installations())))


@query(
    "superseded_ignoring_redelivery",
    f"""WITH {o.REQUESTS}, first AS (SELECT * FROM requests QUALIFY row_number() OVER (PARTITION BY repo_id, head_sha ORDER BY seq) = 1)
    SELECT f.seq, (SELECT min(a.seq) FROM first a WHERE a.installation_id = f.installation_id AND a.repo_full_name = f.repo_full_name
      AND a.ref = f.ref AND a.is_pull_request = f.is_pull_request AND a.seq > f.seq AND a.head_sha <> f.head_sha) AS closed_by_seq FROM first f""",
)
def _superseded_once(t):
    requests = ev.scan_requests(t.repo_events(), t.installations())
    return jb.supersede(requests, ignore_redelivery=True).select("seq", "closed_by_seq")


@query(
    "installation_state",
    f"""WITH {o.REPO_EVENTS}, {o.INSTALLATIONS}, e AS (SELECT inst, seq, ts, CASE WHEN seq % 97 = 0 THEN 'deleted'
      ELSE ['suspend', 'unsuspend', 'created'][CAST(seq % 3 AS INT) + 1] END AS action FROM repo_events WHERE event_type = 'error' AND has_inst),
    last AS (SELECT * FROM e WHERE action IN ('suspend', 'unsuspend') QUALIFY row_number() OVER (PARTITION BY inst ORDER BY seq DESC) = 1)
    SELECT installation_id, account_login, account_type, user_id,
      CASE last.action WHEN 'suspend' THEN last.ts WHEN 'unsuspend' THEN NULL ELSE suspended_at END AS suspended_at
    FROM installations LEFT JOIN last ON inst = installation_id
    WHERE installation_id NOT IN (SELECT inst FROM e WHERE action = 'deleted')""",
)
def _installation_state(t):
    return ev.installation_state(t.installations(), t.repo_events())


@query(
    "installation_state_with_bindings",
    f"""WITH {o.REPO_EVENTS}, {o.INSTALLATIONS}, e AS (SELECT inst, seq, ts, CASE WHEN seq % 97 = 0 THEN 'deleted'
      ELSE ['suspend', 'unsuspend', 'created'][CAST(seq % 3 AS INT) + 1] END AS action FROM repo_events WHERE event_type = 'error' AND has_inst),
    b AS (SELECT event_id AS seq, user_id AS inst, user_id + 5000000 AS owner, CASE WHEN event_id % 2 = 0 THEN 'acct' || event_id ELSE 'unknown' END AS login
      FROM events WHERE event_type = 'purchase' AND event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
    d AS (SELECT inst, max(seq) AS dseq FROM e WHERE action = 'deleted' GROUP BY inst),
    tg AS (SELECT * FROM e WHERE action IN ('suspend', 'unsuspend') QUALIFY row_number() OVER (PARTITION BY inst ORDER BY seq DESC) = 1)
    SELECT coalesce(i.installation_id, b.inst) AS installation_id, coalesce(b.login, i.account_login) AS account_login,
      CASE WHEN b.inst IS NOT NULL THEN 'User' ELSE i.account_type END AS account_type, coalesce(b.owner, i.user_id) AS user_id,
      CASE WHEN tg.seq > coalesce(b.seq, -1) THEN CASE tg.action WHEN 'suspend' THEN tg.ts END WHEN b.inst IS NULL THEN i.suspended_at END AS suspended_at
    FROM installations i FULL JOIN b ON b.inst = i.installation_id
    LEFT JOIN d ON d.inst = coalesce(i.installation_id, b.inst) LEFT JOIN tg ON tg.inst = coalesce(i.installation_id, b.inst)
    WHERE d.dseq IS NULL OR b.seq > d.dseq""",
)
def _installation_bindings(t):
    n = F.col("event_id")
    bindings = t.table("events").filter((F.col("event_type") == "purchase") & (n % 3 == 0)).select(
        n.alias("seq"), F.col("user_id").alias("installation_id"), (F.col("user_id") + 5000000).alias("user_id"),
        F.when(n % 2 == 0, F.concat(F.lit("acct"), n.cast("string"))).alias("account_login"),
        F.lit(None).cast("string").alias("account_type"),
    )
    return ev.installation_state(t.installations(), t.repo_events(), bindings)


@query(
    "remaining_setups",
    f"""WITH {o.REPO_EVENTS}, {o.SETUPS} SELECT user_id, installation_id, repo_full_name FROM repo_setups s
    WHERE NOT EXISTS (SELECT 1 FROM repo_events e WHERE e.has_inst AND e.event_type = 'error' AND e.seq % 97 = 0 AND e.inst = s.installation_id)
      AND NOT EXISTS (SELECT 1 FROM repo_events e WHERE e.has_inst AND e.event_type = 'signup' AND e.seq % 2 = 0
        AND e.inst = s.installation_id AND e.name = s.repo_full_name)""",
)
def _remaining(t):
    return ev.remaining_setups(t.repo_setups(), t.repo_events()).select("user_id", "installation_id", "repo_full_name")


@query(
    "event_names_and_shas",
    f"""WITH {o.REPO_EVENTS} SELECT seq, 'org' || (inst % 20) AS owner, 'r' || (seq % 3) AS repo,
    regexp_matches(sha, '^[0-9a-f]{{7,40}}$') AS is_sha, regexp_matches(name, '^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+$') AS is_repo,
    regexp_matches(event_type, '^[A-Za-z0-9._-]+$') AS is_name FROM repo_events""",
)
def _names(t):
    n, user = F.col("event_id"), F.col("user_id")
    full = F.concat(F.lit("org"), (user % 20).cast("string"), F.lit("/r"), (n % 3).cast("string"))
    sha = F.when(n % 37 == 0, "0000000000").otherwise(
        F.concat(F.lit("a"), F.floor(n / 2000).cast("string"), F.lit("x"), (n % 40).cast("string"))
    )
    return t.table("events").select(
        n.alias("seq"), paths.repo_owner(full).alias("owner"), paths.repo_name(full).alias("repo"),
        paths.is_commit_sha(sha).alias("is_sha"), paths.is_repo_full_name(full).alias("is_repo"),
        paths.is_name(F.col("event_type")).alias("is_name"),
    )


# ---- jobs ------------------------------------------------------------------------------------
_JOB_COLUMNS = [
    "job_id", "installation_id", "created_at", "status", "attempts", "claimed_at", "finished_at", "check_run_id",
    "last_error",
]


@query("job_state", f"WITH {o.JOBS} SELECT {', '.join(_JOB_COLUMNS)} FROM jobs")
def _job_state(t):
    return jb.job_state(t.job_events()).select(*_JOB_COLUMNS)


@query("job_backlog", f"WITH {o.BACKLOG} SELECT job_id, status, attempts, reason FROM backlog")
def _backlog(t):
    return jb.backlog(jb.job_state(t.job_events()), _AS_OF).select("job_id", "status", "attempts", "reason")


@query(
    "fair_order",
    f"WITH {o.BACKLOG} SELECT job_id, installation_id, row_number() OVER (PARTITION BY installation_id ORDER BY created_at, job_id) AS round "
    "FROM backlog WHERE reason <> 'stuck'",
)
def _fair(t):
    ready = jb.claimable(jb.job_state(t.job_events()), _AS_OF)
    return jb.fair_order(ready).select("job_id", "installation_id", "round")


@query(
    "next_claimable",
    f"WITH {o.BACKLOG} SELECT job_id, created_at FROM backlog WHERE reason <> 'stuck' AND installation_id NOT IN (1, 2, 3) "
    "ORDER BY created_at, job_id LIMIT 25",
)
def _next(t):
    excluded = t.job_events().select("installation_id").filter(F.col("installation_id").isin(1, 2, 3)).distinct()
    jobs = jb.claimable(jb.job_state(t.job_events()), _AS_OF, excluded)
    return jobs.orderBy("created_at", "job_id").limit(25).select("job_id", "created_at")


@query(
    "run_totals",
    f"WITH {o.JOB_EVENTS} SELECT installation_id, count(*) FILTER (event = 'claimed') AS claimed, "
    "count(*) FILTER (event = 'done') AS done, count(*) FILTER (event = 'failed') AS failed FROM job_events GROUP BY installation_id",
)
def _run_totals(t):
    return jb.run_totals(t.job_events(), ["installation_id"])


@query(
    "retry_times",
    f"WITH {o.JOBS} SELECT job_id, claimed_at + to_seconds(30 * pow(2, least(attempts, 6))) AS retry_at, "
    "claimed_at + to_seconds(600) AS lease_until FROM jobs WHERE claimed_at IS NOT NULL",
)
def _retry(t):
    jobs = jb.job_state(t.job_events()).filter(F.col("claimed_at").isNotNull())
    return jobs.select(
        "job_id", k.retry_ready_at(F.col("claimed_at"), F.col("attempts")).alias("retry_at"),
        k.lease_expires_at(F.col("claimed_at")).alias("lease_until"),
    )


# ---- rate limits -----------------------------------------------------------------------------
_DAY = 86_400
_CALLS = f"""WITH calls AS (SELECT event_id AS call_id, 'apikey:' || user_id AS subject, ts, (epoch_us(ts) // 1000) // {_DAY * 1000} AS w FROM events)"""


@query(
    "rate_windows",
    f"{_CALLS} SELECT subject, CAST(w AS BIGINT) AS window_index, count(*) AS calls, CAST((w + 1) * {_DAY * 1000} AS BIGINT) AS expires_ms "
    "FROM calls GROUP BY subject, w",
)
def _windows(t):
    return limits.window_counts(t.api_calls(), _DAY)


@query(
    "rate_limit",
    f"""{_CALLS}, n AS (SELECT *, row_number() OVER (PARTITION BY subject, w ORDER BY ts, call_id) AS nth FROM calls)
    SELECT call_id, subject, nth, nth <= 6 AS ok, CASE WHEN nth <= 6 THEN 0 ELSE
      CAST(ceil(((w + 1) * {_DAY * 1000} - (epoch_us(ts) // 1000)) / 1000.0) AS BIGINT) END AS retry_after_sec FROM n""",
)
def _limit(t):
    return limits.rate_limit(t.api_calls(), _DAY).select("call_id", "subject", "nth", "ok", "retry_after_sec")


@query(
    "rate_window_sweep",
    f"{_CALLS} SELECT subject, count(*) AS buckets FROM (SELECT DISTINCT subject, w FROM calls WHERE (w + 1) * {_DAY * 1000} >= 1705276800000) "
    "GROUP BY subject",
)
def _sweep(t):
    live = limits.live_buckets(limits.window_counts(t.api_calls(), _DAY), 1_705_276_800_000)
    return live.groupBy("subject").agg(F.count(F.lit(1)).alias("buckets"))
