"""Queries over scans and their findings: counts, gates, baselines, diffs, posture, controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed_values as fv
from plumbline.functions import keys as k
from plumbline.operators import controls, diff, gate, posture
from plumbline.operators.scan import scan_projects
from plumbline.plans import oracle as o
from plumbline.plans import query

_SF = f"WITH {o.SCANS}, {o.SCAN_FINDINGS}"
_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in fv.SEVERITIES)
_GATE_SQL = (
    "coalesce(r >= {t}, false) AS would_block, CASE WHEN coalesce(r >= {t}, false) THEN '{blocked}' ELSE 'success' END AS conclusion"
)


@query("severity_counts", f"{_SF} SELECT scan_id, {_COUNTS} FROM scan_findings GROUP BY scan_id")
def _severity_counts(t):
    return gate.severity_counts(t.scan_findings(), ["scan_id"])


@query(
    "scan_gate_enforce",
    f"{_SF} SELECT scan_id, {_GATE_SQL.format(t=2, blocked='failure')} FROM scans "
    f"LEFT JOIN (SELECT scan_id, max({o.RANK}) AS r FROM scan_findings GROUP BY scan_id) USING (scan_id)",
)
def _gate_enforce(t):
    return gate.gate(t.scan_findings(), ["scan_id"], "enforce", "MEDIUM", universe=t.scans())


@query(
    "project_gate",
    f"WITH {o.findings_ctes()} SELECT project_id, {_GATE_SQL.format(t=3, blocked='neutral')} FROM "
    f"(SELECT project_id, max({o.RANK}) AS r FROM findings GROUP BY project_id)",
)
def _project_gate(t):
    return gate.gate(scan_projects(t.files()), ["project_id"])


@query(
    "gate_unknown_threshold",
    f"{_SF} SELECT scan_id, max({o.RANK}) >= 3 AS would_block, "
    f"CASE WHEN max({o.RANK}) >= 3 THEN 'failure' ELSE 'success' END AS conclusion FROM scan_findings GROUP BY scan_id",
)
def _gate_unknown(t):
    return gate.gate(t.scan_findings(), ["scan_id"], "enforce", "BOGUS")


@query(
    "scan_totals",
    f"{_SF} SELECT scan_id, count(*) AS findings_count, count(*) FILTER (severity = 'HIGH') AS high_count "
    "FROM scan_findings GROUP BY scan_id",
)
def _totals(t):
    return gate.scan_totals(t.scan_findings(), ["scan_id"])


@query(
    "distinct_finding_ids",
    f"{_SF} SELECT scan_id, count(DISTINCT id) AS ids, count(*) AS findings FROM scan_findings GROUP BY scan_id",
)
def _distinct_ids(t):
    per_id = t.scan_findings().groupBy("scan_id", "id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.groupBy("scan_id").agg(F.count(F.lit(1)).alias("ids"), F.sum("n").alias("findings"))


# ---- baselines and diffs ---------------------------------------------------------------------
_BASE = """base AS (SELECT installation_id, repo, scan_id AS baseline_scan_id FROM scans
  WHERE NOT is_pull_request AND installation_id IS NOT NULL AND repo IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY installation_id, repo ORDER BY created_at DESC, scan_id DESC) = 1)"""
_PAIRS = """pairs AS (SELECT scan_id, CASE WHEN installation_id IS NOT NULL AND repo IS NOT NULL THEN
    last_value(CASE WHEN NOT is_pull_request THEN scan_id END IGNORE NULLS) OVER (PARTITION BY installation_id, repo
      ORDER BY created_at, scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS baseline_scan_id FROM scans)"""
_DIFF = f"""{_SF}, {_PAIRS},
new AS (SELECT f.* FROM scan_findings f JOIN pairs p USING (scan_id) WHERE NOT EXISTS
  (SELECT 1 FROM scan_findings b WHERE b.scan_id = p.baseline_scan_id AND b.id = f.id)),
based AS (SELECT p.scan_id, b.* EXCLUDE (scan_id) FROM pairs p JOIN scan_findings b ON b.scan_id = p.baseline_scan_id),
carried AS (SELECT * FROM based b WHERE EXISTS (SELECT 1 FROM scan_findings f WHERE f.scan_id = b.scan_id AND f.id = b.id)),
resolved AS (SELECT * FROM based b WHERE NOT EXISTS (SELECT 1 FROM scan_findings f WHERE f.scan_id = b.scan_id AND f.id = b.id))"""
_SHOWN = ["scan_id", "id", "severity", "file", "detail"]


@query("baseline_latest", f"{_SF}, {_BASE} SELECT * FROM base")
def _baseline(t):
    return diff.latest_baseline(t.scans())


@query("baseline_history", f"{_SF}, {_PAIRS} SELECT * FROM pairs")
def _history(t):
    return diff.baseline_history(t.scans()).select("scan_id", "baseline_scan_id")


@query("findings_new", f"{_DIFF} SELECT {', '.join(_SHOWN)} FROM new")
def _new(t):
    return diff.new_findings(t.scan_findings(), diff.baseline_history(t.scans())).select(*_SHOWN)


@query("findings_carried", f"{_DIFF} SELECT {', '.join(_SHOWN)} FROM carried")
def _carried(t):
    return diff.carried_findings(t.scan_findings(), diff.baseline_history(t.scans())).select(*_SHOWN)


@query("findings_resolved", f"{_DIFF} SELECT {', '.join(_SHOWN)} FROM resolved")
def _resolved(t):
    return diff.resolved_findings(t.scan_findings(), diff.baseline_history(t.scans())).select(*_SHOWN)


# The fold itself: an id walks from scan to scan for as long as the next default-branch scan still has it.
_PERSISTED = f"""WITH RECURSIVE {o.SCANS}, {o.SCAN_FINDINGS}, {_PAIRS},
mains AS (SELECT scan_id, installation_id, repo,
    row_number() OVER (PARTITION BY installation_id, repo ORDER BY created_at, scan_id) AS n FROM scans
  WHERE NOT is_pull_request AND installation_id IS NOT NULL AND repo IS NOT NULL),
held AS (SELECT DISTINCT m.*, f.id FROM mains m JOIN scan_findings f USING (scan_id)),
walk AS (SELECT h.*, scan_id AS origin FROM held h WHERE NOT EXISTS (SELECT 1 FROM held p
    WHERE p.installation_id = h.installation_id AND p.repo = h.repo AND p.n = h.n - 1 AND p.id = h.id)
  UNION ALL SELECT h.*, w.origin FROM walk w JOIN held h
    ON h.installation_id = w.installation_id AND h.repo = w.repo AND h.n = w.n + 1 AND h.id = w.id),
origins AS (SELECT c.scan_id, c.id, coalesce(w.origin, c.scan_id) AS origin_scan_id,
    CASE WHEN w.origin IS NULL THEN 'new' ELSE 'carried' END AS status
  FROM (SELECT DISTINCT scan_id, id FROM scan_findings) c JOIN pairs p USING (scan_id)
  LEFT JOIN walk w ON w.scan_id = p.baseline_scan_id AND w.id = c.id),
kept AS (SELECT s.scan_id, s.origin_scan_id, s.status, f.* EXCLUDE (scan_id) FROM origins s
  JOIN scan_findings f ON f.scan_id = s.origin_scan_id AND f.id = s.id)"""


@query(
    "persisted_posture_totals",
    f"{_PERSISTED} SELECT scan_id, count(*) AS findings_count, count(*) FILTER (severity = 'HIGH') AS high_count, "
    "count(*) FILTER (status = 'new') AS new_count FROM kept GROUP BY scan_id",
)
def _persisted(t):
    kept = diff.persisted_posture(t.scan_findings(), t.scans())
    return kept.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("findings_count"), F.count_if(F.col("severity") == "HIGH").alias("high_count"),
        F.count_if(F.col("status") == "new").alias("new_count"),
    )


@query(
    "persisted_posture_history",
    f"{_PERSISTED} SELECT {', '.join(_SHOWN)}, status, origin_scan_id FROM kept",
)
def _persisted_history(t):
    return diff.persisted_posture(t.scan_findings(), t.scans()).select(*_SHOWN, "status", "origin_scan_id")


@query(
    "gate_on_new_findings",
    f"{_DIFF} SELECT scan_id, {_GATE_SQL.format(t=3, blocked='neutral')} FROM scans "
    f"LEFT JOIN (SELECT scan_id, max({o.RANK}) AS r FROM new GROUP BY scan_id) USING (scan_id)",
)
def _gate_new(t):
    new = diff.new_findings(t.scan_findings(), diff.baseline_history(t.scans()))
    return gate.gate(new, ["scan_id"], universe=t.scans())


@query(
    "diff_main_against_previous_user_scan",
    f"""{_SF}, ends AS (SELECT user_id, min(scan_id) AS a, max(scan_id) AS b FROM scans GROUP BY user_id),
old AS (SELECT user_id, f.id, f.severity FROM ends JOIN scan_findings f ON f.scan_id = a),
cur AS (SELECT user_id, f.id, f.severity FROM ends JOIN scan_findings f ON f.scan_id = b),
d AS (SELECT c.user_id, 'new' AS status FROM cur c WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.user_id = c.user_id AND old.id = c.id)
  UNION ALL SELECT old.user_id, CASE WHEN EXISTS (SELECT 1 FROM cur WHERE cur.user_id = old.user_id AND cur.id = old.id)
    THEN 'carried' ELSE 'resolved' END FROM old)
SELECT user_id, status, count(*) AS n FROM d GROUP BY user_id, status""",
)
def _two_sets(t):
    ends = t.scans().groupBy("user_id").agg(F.min("scan_id").alias("a"), F.max("scan_id").alias("b"))
    found = t.scan_findings()
    side = lambda c: found.join(ends.select("user_id", F.col(c).alias("scan_id")), "scan_id").drop("scan_id")
    status = diff.diff_against_baseline(side("b"), side("a"), ["user_id"])
    return status.groupBy("user_id", "status").agg(F.count(F.lit(1)).alias("n"))


_COMPARED_SQL = ", ".join("CAST(line AS BIGINT) AS line" if c == "line" else c for c in diff.COMPARED)


@query(
    "compare_finding_sets",
    f"""{_SF}, a AS (SELECT {_COMPARED_SQL} FROM scan_findings WHERE scan_id % 2 = 0),
b AS (SELECT {_COMPARED_SQL} FROM scan_findings WHERE scan_id % 2 = 1)
SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT 'right' AS side, * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
)
def _compare(t):
    found = t.scan_findings().withColumn("line", F.col("line").cast("long"))
    even, odd = found.filter(F.col("scan_id") % 2 == 0), found.filter(F.col("scan_id") % 2 == 1)
    return diff.compare_sets(even, odd)


@query(
    "latest_scan_per_user",
    f"{_SF} SELECT user_id, scan_id, coalesce(repo, '(unknown repo)') AS repo_label, substr(commit_sha, 1, 7) AS short_sha, "
    "CASE WHEN ai_enriched THEN 'enriched' ELSE 'findings only' END AS enriched_label FROM scans "
    "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, scan_id DESC) = 1",
)
def _latest(t):
    shown = diff.scan_header(diff.latest_scan_per_user(t.scans()))
    return shown.select("user_id", "scan_id", "repo_label", "short_sha", "enriched_label")


@query(
    "recent_scans",
    f"""{_SF}, totals AS (SELECT scan_id, count(*) FILTER (severity = 'HIGH') AS high_count FROM scan_findings GROUP BY scan_id),
r AS (SELECT user_id, scan_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, scan_id DESC) AS position FROM scans)
SELECT user_id, scan_id, position, CASE WHEN coalesce(high_count, 0) > 0 THEN 'high' ELSE 'low' END AS chip
FROM r LEFT JOIN totals USING (scan_id) WHERE position <= 5""",
)
def _recent(t):
    top = diff.recent_scans(t.scans(), 5).select("user_id", "scan_id", F.col("position").cast("long").alias("position"))
    totals = gate.scan_totals(t.scan_findings(), ["scan_id"])
    high = F.coalesce("high_count", F.lit(0))
    return top.join(totals, "scan_id", "left").select("user_id", "scan_id", "position", diff.scan_chip(high).alias("chip"))


# ---- posture ---------------------------------------------------------------------------------
_AREA_SQL = f"""{_SF}, {o.AREAS}, {o.REQUIREMENTS}, {o.CATEGORY_REQUIREMENT},
first_req AS (SELECT category, chapter FROM category_requirement c JOIN requirements r ON r.id = c.req_id WHERE ord = 0),
n_req AS (SELECT category, count(*) AS controls FROM category_requirement GROUP BY category),
area_rows AS (SELECT s.scan_id, a.category, a.area_ord, a.label, chapter, controls, count(f.id) AS findings,
    count(*) FILTER (f.severity = 'HIGH') AS high_count
  FROM scans s CROSS JOIN areas a JOIN first_req USING (category) JOIN n_req USING (category)
  LEFT JOIN scan_findings f ON f.scan_id = s.scan_id AND f.asvs_category = a.category GROUP BY ALL),
leveled AS (SELECT *, CASE WHEN high_count > 0 THEN 0 WHEN findings > 0 THEN 1 ELSE 2 END AS level_rank FROM area_rows)"""


@query(
    "area_posture",
    f"""{_AREA_SQL} SELECT scan_id, category, label, chapter, controls, findings, high_count,
    ['vulnerable', 'safer', 'safe'][level_rank + 1] AS level,
    row_number() OVER (PARTITION BY scan_id ORDER BY level_rank, area_ord) - 1 AS position,
    CASE WHEN level_rank = 2 THEN 'nothing to do' ELSE high_count || ' high · ' || findings ||
      CASE WHEN findings = 1 THEN ' finding' ELSE ' findings' END END AS summary FROM leveled""",
)
def _areas(t):
    return posture.area_posture(t.scans(), t.scan_findings()).select(
        "scan_id", "category", "label", "chapter", F.col("controls").cast("long").alias("controls"), "findings",
        "high_count", "level", F.col("position").cast("long").alias("position"), "summary",
    )


@query(
    "overall_posture",
    f"""{_AREA_SQL} SELECT scan_id, ['vulnerable', 'safer', 'safe'][min(level_rank) + 1] AS level,
    ['Vulnerable', 'Safer available', 'Safe'][min(level_rank) + 1] AS level_label,
    ['high', 'medium', 'low'][min(level_rank) + 1] AS level_chip FROM leveled GROUP BY scan_id""",
)
def _overall(t):
    return posture.overall_posture(posture.area_posture(t.scans(), t.scan_findings()))


@query(
    "area_findings",
    f"""{_SF} SELECT scan_id, asvs_category, id, detail, row_number() OVER (PARTITION BY scan_id, asvs_category
    ORDER BY ord, id, detail) AS position FROM scan_findings WHERE asvs_category IN ({o.lits(fv.CATEGORIES)})""",
)
def _area_findings(t):
    return posture.area_findings(t.scan_findings()).select("scan_id", "asvs_category", "id", "detail", "position")


# ---- controls --------------------------------------------------------------------------------
@query(
    "requirements_per_category",
    f"""{_SF}, {o.REQUIREMENTS}, {o.CATEGORY_REQUIREMENT} SELECT asvs_category, CAST(c.ord AS BIGINT) AS ord, req_id, chapter, section, r.title AS req_title,
    count(*) AS findings FROM scan_findings JOIN category_requirement c ON c.category = asvs_category
    JOIN requirements r ON r.id = c.req_id GROUP BY ALL""",
)
def _requirements(t):
    dims = controls.control_dims(t.spark)
    per_category = t.scan_findings().groupBy("asvs_category").agg(F.count(F.lit(1)).alias("findings"))
    return controls.requirements_of_category(per_category, dims).select(
        "asvs_category", F.col("ord").cast("long").alias("ord"), "req_id", "chapter", "section",
        F.col("title").alias("req_title"), "findings",
    )


_ENRICHED = f"""{_SF}, {o.REQUIREMENTS}, {o.CATEGORY_REQUIREMENT},
first_req AS (SELECT c.category, r.id AS req, r.title AS rt, r.text AS rx FROM category_requirement c JOIN requirements r ON r.id = c.req_id WHERE ord = 0),
enriched AS (SELECT f.*, coalesce(req, 'unknown') AS req_id, coalesce(rt, asvs_category) AS req_title,
    coalesce(rx, 'No requirement metadata available.') AS req_text,
    CASE WHEN confidence = 'definitive' THEN 'high' ELSE 'medium' END AS likely
  FROM scan_findings f LEFT JOIN first_req ON category = asvs_category)"""


@query(
    "default_enrichment",
    f"{_ENRICHED} SELECT scan_id, id, req_id, req_title, likely, detail AS explanation, remediation AS steps FROM enriched",
)
def _enrichment(t):
    analyzed = controls.default_enrichment(t.scan_findings(), controls.control_dims(t.spark))
    return analyzed.select(
        "scan_id", "id", F.col("asvs_requirement.id").alias("req_id"), F.col("asvs_requirement.title").alias("req_title"),
        F.col("is_likely_real_issue").alias("likely"), "explanation", F.array_join("remediation_steps", "|").alias("steps"),
    )


@query(
    "submission_enrichment",
    f"{_SF} SELECT scan_id, id, 'unknown' AS req_id, asvs_category AS req_title, "
    "CASE WHEN confidence = 'definitive' THEN 'high' ELSE 'medium' END AS likely FROM scan_findings",
)
def _submission_enrichment(t):
    analyzed = controls.submission_enrichment(t.scan_findings())
    return analyzed.select(
        "scan_id", "id", F.col("asvs_requirement.id").alias("req_id"), F.col("asvs_requirement.title").alias("req_title"),
        F.col("is_likely_real_issue").alias("likely"),
    )


@query(
    "category_labels",
    f"""{_SF}, mapped AS (SELECT CASE WHEN asvs_category IN ({o.lits(fv.CATEGORIES)}) THEN asvs_category
      WHEN asvs_category = 'ASVS: Security Configuration' THEN 'CONFIG' END AS key FROM scan_findings)
    SELECT key, CASE key WHEN 'ACCESS' THEN {o.lit(fv.CATEGORY_LABEL['ACCESS'])} WHEN 'SECRETS' THEN {o.lit(fv.CATEGORY_LABEL['SECRETS'])}
      WHEN 'CONFIG' THEN {o.lit(fv.CATEGORY_LABEL['CONFIG'])} WHEN 'INJECTION' THEN {o.lit(fv.CATEGORY_LABEL['INJECTION'])} END AS label,
    count(*) AS n FROM mapped GROUP BY key""",
)
def _labels(t):
    key = k.category_key(F.col("asvs_category"))
    grouped = t.scan_findings().groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("key", k.category_label(F.col("key")).alias("label"), "n")


@query(
    "finding_keys",
    f"{_SF} SELECT scan_id, id, 'pf_' || substr(sha256(file || '|' || title || '|'), 1, 12) AS line_free, "
    "sha256(id || chr(0) || coalesce(code_snippet, '') || chr(0) || coalesce(detail, '')) AS cache_key FROM scan_findings",
)
def _finding_keys(t):
    return t.scan_findings().select(
        "scan_id", "id", k.line_free_id(F.col("file"), F.col("title")).alias("line_free"),
        k.cache_key(F.col("id"), F.col("code_snippet"), F.col("detail")).alias("cache_key"),
    )
