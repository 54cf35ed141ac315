"""Queries over billing events, submissions, the enrichment cache and archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed_values as fv
from plumbline.operators import billing, controls, enrichment as en, report
from plumbline.plans import oracle as o, views
from plumbline.plans import query
from plumbline.plans.findings import _ENRICHED
from plumbline.sources import archives, submissions as sub

_BY_ARRIVAL = o.BILLING.replace("{order}", "arrival_seq")
_BY_CREATED = o.BILLING.replace("{order}", "created DESC, arrival_seq")
_STATE = ["user_id", "stripe_customer_id", "stripe_subscription_id", "status", "price_id", "current_period_end"]


@query("event_ledger", f"WITH {_BY_ARRIVAL} SELECT id, arrival_seq FROM first_seen")
def _ledger(t):
    return billing.first_deliveries(t.billing_events()).select("id", "arrival_seq")


@query(
    "subscription_patches",
    f"WITH {_BY_ARRIVAL} SELECT id, customer_id, subscription_id, status, price_id, current_period_end FROM patches",
)
def _patches(t):
    return billing.subscription_patches(billing.first_deliveries(t.billing_events())).select(
        "id", "customer_id", "subscription_id", "status", "price_id", "current_period_end"
    )


@query("subscription_state", f"WITH {_BY_ARRIVAL} SELECT {', '.join(_STATE)} FROM state")
def _state(t):
    return billing.billing_state(t.billing_events(), t.subscriptions()).select(*_STATE)


@query("subscription_state_by_creation", f"WITH {_BY_CREATED} SELECT {', '.join(_STATE)} FROM state")
def _state_created(t):
    return billing.billing_state(t.billing_events(), t.subscriptions(), "created").select(*_STATE)


@query(
    "unknown_customers",
    f"WITH {_BY_ARRIVAL} SELECT id, customer_id FROM patches WHERE customer_id NOT IN (SELECT stripe_customer_id FROM subs)",
)
def _unknown(t):
    return billing.unknown_customers(t.billing_events(), t.subscriptions()).select("id", "customer_id")


@query(
    "scan_entitlements",
    f"""WITH {_BY_ARRIVAL}, {o.SCANS} SELECT scan_id, coalesce(state.status IN ('active', 'trialing'), false) AS active
    FROM scans LEFT JOIN state USING (user_id)""",
)
def _entitled(t):
    state = billing.billing_state(t.billing_events(), t.subscriptions())
    return billing.with_entitlement(t.scans(), state).select("scan_id", "active")


@query(
    "billing_flags",
    f"WITH {_BY_ARRIVAL} SELECT user_id, status IN ('active', 'trialing') AS active, "
    "status IN ('past_due', 'unpaid', 'incomplete') AS billing_issue FROM state",
)
def _flags(t):
    state = billing.billing_state(t.billing_events(), t.subscriptions())
    return billing.entitlements(state).select("user_id", "active", "billing_issue")


# ---- submissions -----------------------------------------------------------------------------
_SUBMITTED = """WITH s AS (SELECT event_id AS submission_id, user_id, CASE WHEN event_id % 997 = 5 THEN 'too_large' WHEN event_id % 19 = 0 THEN 'not_json'
    WHEN event_id % 17 = 0 THEN 'no_findings_list' ELSE 'ok' END AS status FROM events),
f AS (SELECT submission_id, i, row_number() OVER (PARTITION BY submission_id ORDER BY i) - 1 AS ord
  FROM s, UNNEST(range(1, submission_id % 130 + 2)) AS r(i) WHERE status = 'ok' AND i % 7 <> 3),
kept AS (SELECT * FROM f WHERE ord < 100)"""


@query(
    "submission_headers",
    f"""{_SUBMITTED} SELECT submission_id, status, CASE WHEN status IN ('ok', 'no_findings_list') AND submission_id % 3 <> 0 THEN 'org/r' END AS repo,
    CASE WHEN status IN ('ok', 'no_findings_list') THEN 'main' END AS ref, coalesce(n, 0) AS valid
    FROM s LEFT JOIN (SELECT submission_id, count(*) AS n FROM f GROUP BY submission_id) USING (submission_id)""",
)
def _headers(t):
    parsed = sub.parse_submissions(t.submissions(), kept=[])
    return parsed.select("submission_id", "status", "repo", "ref", F.col("valid").cast("long").alias("valid"))


@query(
    "submitted_findings",
    f"{_SUBMITTED} SELECT submission_id, ord, 'f' || i AS id, CASE WHEN i % 5 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity, "
    "CAST(i AS BIGINT) AS line FROM kept",
)
def _submitted(t):
    rows = sub.submitted_findings(sub.parse_submissions(t.submissions(), kept=["id", "severity", "line"]))
    return rows.select("submission_id", "ord", "id", "severity", F.col("line").cast("long").alias("line"))


@query(
    "submission_results",
    f"""{_SUBMITTED}, c AS (SELECT submission_id, count(*) AS n, count(*) FILTER (i % 5 = 0) AS h FROM kept GROUP BY submission_id)
    SELECT submission_id, CASE WHEN user_id % 3 <> 0 AND (n IS NULL OR submission_id % 2 = 0) THEN 'ok' ELSE 'unavailable' END AS enrichment,
      CASE WHEN user_id % 3 = 0 THEN 'subscription_required' WHEN n IS NOT NULL AND submission_id % 2 <> 0 THEN 'unavailable' END AS enrichment_error,
      user_id % 3 <> 0 AND submission_id % 2 = 0 AND n IS NOT NULL AS ai_enriched, coalesce(n, 0) AS findings_count, coalesce(h, 0) AS high_count
    FROM s LEFT JOIN c USING (submission_id) WHERE status = 'ok'""",
)
def _results(t):
    parsed = sub.parse_submissions(t.submissions(), kept=["severity"])
    result = sub.submission_result(parsed, F.col("user_id") % 3 != 0, F.col("submission_id") % 2 == 0)
    return result.select(
        "submission_id", "enrichment", "enrichment_error", "ai_enriched", "findings_count", "high_count"
    )


@query(
    "cli_findings",
    """WITH r AS (SELECT l_orderkey AS k, l_linenumber AS line, l_suppkey AS s, l_partkey AS p,
      CASE WHEN l_suppkey % 3 <> 0 THEN 'T' || (l_partkey % 5) END AS title, CASE WHEN l_suppkey % 4 <> 0 THEN lower(l_returnflag) END AS sev,
      CASE WHEN l_suppkey % 5 <> 0 THEN 'f.ts' END AS file FROM lineitem)
    SELECT k, p, 'pf_' || substr(sha256(coalesce(file, 'undefined') || '|' || coalesce(title, 'undefined') || '|' || line), 1, 12) AS id,
      coalesce(title, 'Untitled finding') AS title, upper(coalesce(sev, 'INFO')) AS severity, 'heuristic' AS confidence,
      'ASVS' AS asvs_category, coalesce(file, '(unknown)') AS file, '' AS detail FROM r""",
)
def _cli(t):
    supp = F.col("l_suppkey")
    nothing = F.lit(None).cast("string")
    raw = t.table("lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("line"),
        F.when(supp % 3 != 0, F.concat(F.lit("T"), (F.col("l_partkey") % 5).cast("string"))).alias("title"),
        F.when(supp % 4 != 0, F.lower("l_returnflag")).alias("severity"), F.when(supp % 5 != 0, "f.ts").alias("file"),
        nothing.alias("confidence"), nothing.alias("asvs"), nothing.alias("detail"), nothing.alias("remediation"),
    )
    return sub.coerce_cli_findings(raw).select(
        "k", "p", "id", "title", "severity", "confidence", "asvs_category", "file", "detail"
    )


@query(
    "commit_choice",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'env' || o_orderkey ELSE 'pay' || o_orderkey END AS sha FROM orders",
)
def _commit(t):
    key = F.col("o_orderkey")
    payload = F.when(key % 3 != 0, F.concat(F.lit("pay"), key.cast("string"))).otherwise(F.when(key % 2 == 0, ""))
    return t.table("orders").select(
        "o_orderkey", sub.commit_choice(payload, F.concat(F.lit("env"), key.cast("string"))).alias("sha")
    )


@query(
    "tagged_observations",
    "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_id % 3 ELSE NULL END AS n, "
    "CASE WHEN event_id % 3 > 0 THEN 'inferred' END AS confidence FROM events",
)
def _observations(t):
    n = F.col("event_id") % 3
    item = lambda i: F.struct(F.lit("seen").alias("description"), F.lit("LOW").alias("severity"))
    listed = F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), item)).otherwise(
        F.expr("array()").cast("array<struct<description:string,severity:string>>")
    )
    tagged = sub.tag_observations(listed)
    return t.table("events").select(
        "event_id", F.when(tagged.isNotNull(), F.size(tagged)).cast("long").alias("n"),
        tagged[0]["confidence"].alias("confidence"),
    )


# ---- enrichment cache ------------------------------------------------------------------------
_KEY = "sha256(id || chr(0) || coalesce(code_snippet, '') || chr(0) || detail)"
_CACHE = f"""{_ENRICHED}, keyed AS (SELECT *, {_KEY} AS cache_key FROM enriched),
cache AS (SELECT DISTINCT cache_key, CASE WHEN substr(cache_key, 1, 1) < '8' THEN 'model-a' ELSE 'model-b' END AS model
  FROM keyed WHERE substr(cache_key, 2, 1) < '8')"""


def _cache(t, keep=lambda keys: keys):
    """The cache; ``keep`` may stage its keys."""
    first, second = F.substring("cache_key", 1, 1), F.substring("cache_key", 2, 1)
    keyed = keep(en.with_cache_key(t.scan_findings()).select("cache_key").filter(second < "8").distinct())
    return keyed.select(
        "cache_key", F.lit("cached").alias("req_id"), F.lit("cached title").alias("req_title"), F.lit("low").alias("likely"),
        F.concat(F.lit("cached "), F.col("cache_key")).alias("explanation"), F.array(F.lit("s")).alias("steps"),
        F.lit(None).cast("string").alias("example"),
        F.when(first < "8", "model-a").otherwise("model-b").alias("model"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"), F.lit(3).cast("long").alias("hit_count"),
    )


@query(
    "cache_lookup",
    f"""{_CACHE} SELECT scan_id, id, detail, c.cache_key IS NOT NULL AS cached,
    CASE WHEN c.cache_key IS NOT NULL THEN 'cached ' || c.cache_key END AS explanation
    FROM keyed k LEFT JOIN cache c ON c.cache_key = k.cache_key AND c.model = 'model-a'""",
)
def _lookup(t):
    found = en.cache_lookup(t.scan_findings(), _cache(t), "model-a")
    return found.select("scan_id", "id", "detail", "cached", "explanation")


@query(
    "uncached_findings",
    f"{_CACHE} SELECT scan_id, id, cache_key FROM keyed WHERE cache_key NOT IN (SELECT cache_key FROM cache WHERE model = 'model-a')",
)
def _uncached(t):
    return en.uncached(t.scan_findings(), _cache(t), "model-a").select("scan_id", "id", "cache_key")


_RESPONSES = """responses AS (SELECT scan_id, id, max(ord) AS ord FROM keyed WHERE ord % 3 = 0 GROUP BY scan_id, id)"""


def _responses(t):
    found = t.scan_findings().filter(F.col("ord") % 3 == 0)
    return found.select(
        "scan_id", "id", "ord", F.lit("high").alias("likely"),
        F.concat(F.lit("answer "), F.col("ord").cast("string")).alias("explanation"),
        F.array(F.lit("a"), F.lit("b")).alias("steps"), F.lit(None).cast("string").alias("example"),
    )


@query(
    "merged_responses",
    f"""{_CACHE}, {_RESPONSES} SELECT k.scan_id, k.id, k.detail, r.id IS NOT NULL AS answered, req_id,
    CASE WHEN r.id IS NOT NULL THEN 'high' ELSE k.likely END AS likely,
    CASE WHEN r.id IS NOT NULL THEN 'answer ' || r.ord ELSE detail END AS explanation,
    CASE WHEN r.id IS NOT NULL THEN 'a|b' ELSE remediation END AS steps
    FROM keyed k LEFT JOIN responses r ON r.scan_id = k.scan_id AND r.id = k.id""",
)
def _merged(t):
    merged = en.merge_responses(t.scan_findings(), _responses(t), controls.control_dims(t.spark))
    return merged.select(
        "scan_id", "id", "detail", "answered", "req_id", "likely", "explanation", F.array_join("steps", "|").alias("steps")
    )


@query(
    "enriched_findings",
    f"""{_CACHE} SELECT scan_id, id, detail, c.cache_key IS NOT NULL AS cached,
    CASE WHEN c.cache_key IS NOT NULL THEN 'cached' ELSE req_id END AS req_id,
    CASE WHEN c.cache_key IS NOT NULL THEN 'cached ' || c.cache_key ELSE detail END AS explanation
    FROM keyed k LEFT JOIN cache c ON c.cache_key = k.cache_key AND c.model = 'model-a'""",
)
def _enriched(t):
    found = en.enrich(t.scan_findings(), _cache(t), "model-a", controls.control_dims(t.spark))
    return found.select("scan_id", "id", "detail", "cached", "req_id", "explanation")


@query(
    "cache_hits",
    f"""{_CACHE} SELECT k.cache_key, count(DISTINCT scan_id) AS hits FROM keyed k JOIN cache c
    ON c.cache_key = k.cache_key AND c.model = 'model-a' GROUP BY k.cache_key""",
)
def _hits(t):
    return en.cache_hits(en.cache_lookup(t.scan_findings(), _cache(t), "model-a"), "scan_id")


def fresh_answers(t):
    return en.with_cache_key(t.scan_findings()).filter(F.col("ord") % 5 == 0).select(
        "cache_key", "ord", "id", F.lit("r").alias("req_id"), F.lit("t").alias("req_title"), F.lit("high").alias("likely"),
        F.col("detail").alias("explanation"), F.array("remediation").alias("steps"), F.lit(None).cast("string").alias("example"),
    )


@query(
    "cache_upsert",
    f"""{_CACHE}, fresh AS (SELECT cache_key, arg_max(detail, (ord, id)) AS d FROM keyed WHERE ord % 5 = 0 GROUP BY cache_key)
    SELECT coalesce(c.cache_key, f.cache_key) AS cache_key, CASE WHEN f.cache_key IS NOT NULL THEN 'model-a' ELSE model END AS model,
      CASE WHEN f.cache_key IS NOT NULL THEN d ELSE 'cached ' || c.cache_key END AS explanation,
      CASE WHEN f.cache_key IS NOT NULL THEN TIMESTAMP '2024-06-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS created_at,
      CAST(CASE WHEN c.cache_key IS NOT NULL THEN 3 ELSE 0 END AS BIGINT) AS hit_count
    FROM cache c FULL JOIN fresh f ON f.cache_key = c.cache_key""",
)
def _upsert(t):
    return en.cache_upsert(_cache(t), fresh_answers(t), "model-a", "2024-06-01 00:00:00").select(
        "cache_key", "model", "explanation", "created_at", "hit_count"
    )


# ---- archives --------------------------------------------------------------------------------
_FAULT = "CASE file_seq % 50 " + " ".join(f"WHEN {n} THEN '{fault}'" for n, fault in views.ARCHIVE_FAULTS.items()) + " ELSE 'ok' END"
_STATUS = f"CASE WHEN {_FAULT} IN ('cut', 'empty') THEN 'ok' ELSE {_FAULT} END"


def _unpacked(t):
    return archives.unpack_archives(t.archives(), max_archive=views.ARCHIVE_LIMIT)


@query(
    "expanded_archives",
    f"""WITH {o.FILES}, {o.CLASSIFIED}, direct AS (SELECT project_id || '-' || file_seq AS project_id, path, content FROM classified
      WHERE kind IS NOT NULL AND {_FAULT} IN ('ok', 'cut'))
    SELECT project_id, path, sha256(content) AS digest, false AS truncated FROM direct
    UNION ALL SELECT project_id || '-' || file_seq, 'long/' || repeat('d', 120) || '/a.ts', sha256(content), false FROM files WHERE {_FAULT} = 'ok'""",
)
def _archives(t):
    files, _ = _unpacked(t)
    return files.select("project_id", "path", F.sha2("content", 256).alias("digest"), "truncated")


@query("archive_statuses", f"WITH {o.FILES} SELECT project_id || '-' || file_seq AS project_id, {_STATUS} AS status, false AS truncated FROM files")
def _statuses(t):
    return _unpacked(t)[1]


@query(
    "archive_check_results",
    f"""WITH {o.FILES} SELECT project_id || '-' || file_seq AS project_id, CASE WHEN {_STATUS} = 'ok' THEN 'success' ELSE 'neutral' END AS conclusion,
      CASE WHEN {_STATUS} = 'ok' THEN 'read' ELSE {o.lit(fv.NEUTRAL_TITLE.replace("{tool}", fv.TOOL_NAME))} END AS title,
      CASE WHEN {_STATUS} = 'ok' THEN '' ELSE replace({o.lit(fv.NEUTRAL_SUMMARY.replace("{tool}", fv.TOOL_NAME))}, '{{reason}}', {_STATUS}) END AS summary
    FROM files""",
)
def _archive_results(t):
    """Archives that could not be read end in a neutral check with the reason; the others get their report."""
    _, statuses = _unpacked(t)
    reports = statuses.select("project_id", F.lit("success").alias("conclusion"), F.lit("read").alias("title"), F.lit("").alias("summary"), F.lit("").alias("text"))
    results = report.check_results(reports, archives.failed_archives(statuses), ["project_id"])
    return results.select("project_id", "conclusion", "title", "summary")
