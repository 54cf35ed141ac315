"""Queries that render findings: annotations, bodies, documents, request texts, progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed_values as fv
from plumbline.operators import controls, posture, report
from plumbline.operators.scan import admit_files, scan_projects, scanned_counts
from plumbline.plans import ORACLE, oracle as o
from plumbline.plans import query
from plumbline.plans.findings import _AREA_SQL, _ENRICHED, _SF
from plumbline.session import stage

_LOC = "file || CASE WHEN line IS NOT NULL AND line <> 0 THEN ':' || line ELSE '' END"
_MD = f"""'### [' || severity || '] ' || title || chr(10) || '`' || {_LOC} || '`  ·  ' || confidence || chr(10) || chr(10) || detail
  || chr(10) || CASE WHEN remediation <> '' THEN chr(10) || '**Fix:** ' || remediation ELSE '' END"""
_SEP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
_SEP_LIT = "'\n\n---\n\n'"


@query(
    "annotations",
    f"""{_SF}, n AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY ord, id, detail) AS position
      FROM scan_findings WHERE file NOT LIKE '(%')
    SELECT scan_id, position, (position - 1) // 3 AS batch, file AS path, CAST(coalesce(line, 1) AS BIGINT) AS start_line,
      CASE severity WHEN 'HIGH' THEN 'failure' WHEN 'MEDIUM' THEN 'warning' ELSE 'notice' END AS annotation_level,
      substr('[' || severity || '] ' || title, 1, 255) AS title,
      substr(detail || CASE WHEN remediation <> '' THEN chr(10) || chr(10) || 'Fix: ' || remediation ELSE '' END, 1, 4000) AS message
    FROM n""",
)
def _annotations(t):
    return report.annotations(t.scan_findings(), ["scan_id"], batch=3).drop("end_line")


@query(
    "report_bodies",
    f"""{_SF}, c AS (SELECT scan_id, count(*) FILTER (severity = 'HIGH') AS h, count(*) FILTER (severity = 'MEDIUM') AS m,
        count(*) FILTER (severity = 'LOW') AS l, count(*) FILTER (severity = 'INFO') AS i,
        substr(string_agg({_MD}, {_SEP_LIT} ORDER BY {o.RANK} DESC, ord, id, detail), 1, 60000) AS text
      FROM scan_findings GROUP BY scan_id),
    z AS (SELECT scan_id, coalesce(h, 0) AS h, coalesce(m, 0) AS m, coalesce(l, 0) AS l, coalesce(i, 0) AS i, text
      FROM scans LEFT JOIN c USING (scan_id))
    SELECT scan_id, h > 0 AS would_block, CASE WHEN h > 0 THEN 'failure' ELSE 'success' END AS conclusion,
      h || ' high · ' || m || ' medium · ' || l || ' low' AS title,
      '**' || h || ' high · ' || m || ' medium · ' || l || ' low · ' || i || ' info**' || chr(10) || chr(10) ||
      CASE WHEN h > 0 THEN 'Gate **failed** — findings at or above `HIGH`. Production promotion is held.'
           ELSE 'Gate **passed** — no findings at or above `HIGH`.' END AS summary,
      coalesce(text, 'No findings.') AS text FROM z""",
)
def _bodies(t):
    return report.render_report(t.scan_findings(), ["scan_id"], "enforce", universe=t.scans())


@query(
    "ci_reports",
    f"""{_ENRICHED}, md AS (SELECT scan_id, ord, id, detail, {o.RANK} AS r, severity, '### [' || severity || '] ' || title || chr(10) || '`' || {_LOC} || '`  ·  '
        || req_title || '  ·  ' || confidence || chr(10) || chr(10) || detail || chr(10)
        || CASE WHEN remediation <> '' THEN chr(10) || '**Fix:** ' || remediation ELSE '' END AS m FROM enriched),
    c AS (SELECT scan_id, count(*) FILTER (severity = 'HIGH') AS h, count(*) FILTER (severity = 'MEDIUM') AS me, count(*) FILTER (severity = 'LOW') AS l,
        count(*) FILTER (severity = 'INFO') AS i, substr(string_agg(m, {_SEP_LIT} ORDER BY r DESC, ord, id, detail), 1, 60000) AS text FROM md GROUP BY scan_id)
    SELECT scan_id, CASE WHEN coalesce(h, 0) > 0 THEN 'failure' ELSE 'success' END AS conclusion,
      '**' || coalesce(h, 0) || ' high · ' || coalesce(me, 0) || ' medium · ' || coalesce(l, 0) || ' low · ' || coalesce(i, 0) || ' info**' || chr(10) || chr(10) ||
      CASE WHEN h > 0 THEN {o.lit(fv.CI_GATE_FAILED.replace('{fail_on}', 'HIGH'))} ELSE {o.lit(fv.GATE_PASSED.replace('{fail_on}', 'HIGH'))} END ||
      CASE user_id % 4 WHEN 0 THEN {o.lit(fv.NOTE_SUBSCRIPTION)} WHEN 1 THEN {o.lit(fv.NOTE_UNAVAILABLE)}
        WHEN 2 THEN {o.lit(fv.NOTE_REQUEST_FAILED.replace('{reason}', 'HTTP 500'))} ELSE '' END AS summary,
      coalesce(text, 'No findings.') AS text FROM scans LEFT JOIN c USING (scan_id)""",
)
def _ci_reports(t):
    analyzed = controls.default_enrichment(t.scan_findings(), controls.control_dims(t.spark))
    kind = F.col("user_id") % 4
    outcomes = t.scans().select(
        "scan_id", F.when(kind < 2, "unavailable").otherwise("ok").alias("enrichment"),
        F.when(kind == 0, "subscription_required").alias("enrichment_error"),
        F.when(kind == 2, "HTTP 500").alias("request_error"),
    )
    return report.render_ci_report(analyzed, outcomes, ["scan_id"]).drop("title")


@query(
    "report_text_cut",
    f"""{_SF} SELECT severity AS level, substr(string_agg({_MD}, {_SEP_LIT} ORDER BY {o.RANK} DESC, ord, id, detail), 1, 60000) AS text
      FROM scan_findings GROUP BY severity""",
)
def _text_cut(t):
    found = t.scan_findings().withColumn("level", F.col("severity"))
    return report.report_text(found, ["level"])


_BLOCKED, _REPORTED = (o.lit(x.replace("{fail_on}", "HIGH")) for x in (fv.GATE_FAILED, fv.GATE_REPORT_ONLY))
_NEUTRAL = [o.lit(x.replace("{tool}", fv.TOOL_NAME).replace("{reason}", "scan_error")) for x in (fv.NEUTRAL_TITLE, fv.NEUTRAL_SUMMARY, fv.NEUTRAL_TEXT)]


@query(
    "check_results",
    f"""SELECT b.scan_id, CASE WHEN failed OR would_block THEN 'neutral' ELSE 'success' END AS conclusion,
      CASE WHEN failed THEN {_NEUTRAL[0]} ELSE title END AS title,
      CASE WHEN failed THEN {_NEUTRAL[1]} ELSE replace(summary, {_BLOCKED}, {_REPORTED}) END AS summary,
      CASE WHEN failed THEN {_NEUTRAL[2]} ELSE text END AS text
    FROM ({ORACLE["report_bodies"]}) b
    JOIN (SELECT o_orderkey AS scan_id, o_custkey % 17 = 0 AS failed FROM orders) u ON u.scan_id = b.scan_id""",
)
def _check_results(t):
    keys = ["scan_id"]
    failed = t.scans().filter(F.col("user_id") % 17 == 0).select("scan_id", F.lit("scan_error").alias("reason"))
    return report.check_results(report.render_report(t.scan_findings(), keys, universe=t.scans()), failed, keys)


@query(
    "request_texts",
    f"""{_ENRICHED}, n AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY ord, id, detail) AS p FROM enriched),
    b AS (SELECT scan_id, (p - 1) // 100 AS page, p, '--- Finding ' || p || ' (id: ' || id || ') ---' || chr(10) || 'Title: ' || title
      || chr(10) || 'Severity: ' || severity || '   Confidence: ' || confidence || chr(10) || 'Location: ' || {_LOC} || chr(10)
      || 'Scanner detail: ' || detail || chr(10) || 'ASVS requirement: ' || req_id || ' — ' || req_title || chr(10)
      || 'ASVS text: ' || req_text || chr(10)
      || CASE WHEN code_snippet IS NOT NULL THEN 'Code:' || chr(10) || '```' || chr(10) || code_snippet || chr(10) || '```' || chr(10) ELSE '' END AS block
      FROM n)
    SELECT scan_id, page, count(*) AS findings, {o.lit(fv.REQUEST_HEAD)} || string_agg(block, chr(10) ORDER BY p) || {o.lit(fv.REQUEST_FOOT)} AS text
    FROM b GROUP BY scan_id, page""",
)
def _requests(t):
    found = controls.primary_requirement(t.scan_findings(), controls.control_dims(t.spark))
    return report.request_text(found, ["scan_id"])


@query(
    "area_request_texts",
    f"""{_AREA_SQL}, fr AS (SELECT c.category, r.id AS req_id, r.title AS req_title FROM category_requirement c
        JOIN requirements r ON r.id = c.req_id WHERE ord = 0),
    n AS (SELECT f.*, req_id, req_title, row_number() OVER (PARTITION BY scan_id, asvs_category ORDER BY ord, f.id, detail) AS p
      FROM scan_findings f JOIN fr ON fr.category = asvs_category),
    b AS (SELECT scan_id, asvs_category, (p - 1) // 100 AS page, p, '--- Finding ' || p || ' (id: ' || id || ') ---' || chr(10) || 'Title: ' || title
      || chr(10) || 'Severity: ' || severity || '   Confidence: ' || confidence || chr(10) || 'Location: ' || {_LOC} || chr(10)
      || 'ASVS: ' || req_id || ' — ' || req_title || chr(10) || 'Scanner detail: ' || detail || chr(10)
      || CASE WHEN code_snippet IS NOT NULL THEN 'Code:' || chr(10) || '```' || chr(10) || code_snippet || chr(10) || '```' || chr(10) ELSE '' END AS block
      FROM n),
    g AS (SELECT scan_id, asvs_category, page, count(*) AS findings, string_agg(block, chr(10) ORDER BY p) AS body FROM b GROUP BY ALL)
    SELECT g.scan_id, asvs_category, page, g.findings, 'ASVS area: ' || label || ' (' || chapter || ')' || chr(10) || 'Findings in this area: '
      || a.findings || chr(10) || chr(10) || body AS text
    FROM g JOIN area_rows a ON a.scan_id = g.scan_id AND a.category = asvs_category""",
)
def _area_requests(t):
    found = t.scan_findings().filter(F.col("asvs_category").isin(fv.CATEGORIES))
    with_requirement = controls.primary_requirement(found, controls.control_dims(t.spark))
    areas = posture.area_posture(t.scans(), found)
    return report.area_request_text(with_requirement, areas, ["scan_id"])


def _project_findings(t):
    found = scan_projects(t.files())
    return stage(found.withColumn("ord", report.rule_order()))


@query(
    "report_documents",
    f"WITH {o.findings_ctes()}, n AS (SELECT project_id, count(*) AS n, count(*) FILTER (severity = 'HIGH') AS high, "
    "count(*) FILTER (severity = 'INFO') AS info FROM findings GROUP BY project_id) "
    "SELECT project_id, CAST(p AS BIGINT) AS page, least(10, n - 10 * p) AS findings, high, info, "
    f"'{fv.TOOL_NAME}' AS tool FROM n, UNNEST(range(0, CAST(ceil(n / 10) AS BIGINT))) AS r(p)",
)
def _documents(t):
    pages = report.report_documents(_project_findings(t), scanned_counts(t.files()), page_size=10)
    shape = "tool string, counts struct<HIGH:bigint,INFO:bigint>, findings array<struct<title:string>>"
    doc = F.from_json("json", shape)
    return pages.withColumn("d", doc).select(
        "project_id", "page", F.size("d.findings").cast("long").alias("findings"), F.col("d.counts.HIGH").alias("high"),
        F.col("d.counts.INFO").alias("info"), F.col("d.tool").alias("tool"),
    )


@query(
    "console_report",
    f"WITH {o.findings_ctes()}, "
    "s AS (SELECT p.project_id, count(*) FILTER (c.kind = 'code') AS code, count(*) FILTER (c.kind = 'sql') AS sql "
    "FROM files p LEFT JOIN classified c USING (file_seq) GROUP BY p.project_id), "
    f"g AS (SELECT project_id, {', '.join(f'count(*) FILTER (severity = {o.lit(x)}) AS {x.lower()}' for x in fv.SEVERITIES)}, "
    "count(*) AS n FROM findings GROUP BY project_id) "
    f"SELECT project_id, '{fv.TOOL_NAME}: scanned ' || code || ' code + ' || sql || ' SQL files' AS head, n AS entries, "
    "'Summary  ' || high || ' high · ' || medium || ' medium · ' || low || ' low · ' || info || ' info' AS summary "
    "FROM s JOIN g USING (project_id)",
)
def _console(t):
    pages = report.console_pages(_project_findings(t), scanned_counts(t.files()), page_size=10)
    entries = F.size(F.split("body", "\n   Fix: ")) - 1
    return pages.groupBy("project_id", "head", "summary").agg(F.sum(entries).alias("entries"))


# The scan of the admitted files only: at most 30 of a project, of 20,000 bytes at most.
_ADMITTED_FINDINGS = o.findings_ctes().replace("classified AS (", "admissible AS (", 1).replace(
    "hits AS (",
    """ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY file_seq) AS rn, count(*) OVER (PARTITION BY project_id) AS n
  FROM admissible WHERE kind IS NOT NULL AND strlen(content) <= 20000),
classified AS (SELECT * EXCLUDE (rn, n), n > 30 AS truncated FROM ranked WHERE rn <= 30),
hits AS (""", 1)


@query(
    "progress_feed",
    f"""WITH {_ADMITTED_FINDINGS}, s AS (SELECT project_id, count(*) AS files, count(*) FILTER (kind = 'code') AS code,
        count(*) FILTER (kind = 'sql') AS sql, bool_or(truncated) AS truncated FROM classified GROUP BY project_id),
    base AS (SELECT * FROM findings WHERE file_seq % 3 <> 0),
    marked AS (SELECT *, (project_id, id) IN (SELECT (project_id, id) FROM base) AS known FROM findings),
    kept AS (SELECT project_id, severity, true AS fresh FROM marked WHERE NOT known
      UNION ALL SELECT project_id, severity, false FROM base),
    g AS (SELECT project_id, count(*) AS total FROM findings GROUP BY project_id),
    k AS (SELECT project_id, count(*) AS persisted, count(*) FILTER (fresh) AS new, count(*) FILTER (severity = 'HIGH') AS high FROM kept GROUP BY project_id),
    j AS (SELECT s.project_id, files, code, sql, truncated, coalesce(total, 0) AS total, coalesce(persisted, 0) AS persisted,
        coalesce(new, 0) AS new, coalesce(high, 0) AS high FROM s LEFT JOIN g USING (project_id) LEFT JOIN k USING (project_id))
    SELECT project_id, CAST(0 AS BIGINT) AS step, 'log' AS type, 'Downloaded ' || files || ' scannable file' || CASE WHEN files = 1 THEN '' ELSE 's' END
      || CASE WHEN truncated THEN ' (file cap reached)' ELSE '' END || '.' AS message, NULL::BIGINT AS findings, NULL::BIGINT AS high FROM j
    UNION ALL SELECT project_id, 1, 'log', 'Scanned ' || code || ' code + ' || sql || ' SQL files — ' || total || ' finding'
      || CASE WHEN total = 1 THEN '' ELSE 's' END || ' total.', NULL, NULL FROM j
    UNION ALL SELECT project_id, 2, 'log', new || ' new since last scan.', NULL, NULL FROM j
    UNION ALL SELECT project_id, 3, 'done', NULL, persisted, high FROM j""",
)
def _progress(t):
    admitted = stage(admit_files(t.files(), max_bytes=20000, max_files=30))
    found = stage(scan_projects(admitted.select("project_id", "file_seq", "path", "content")))
    # The last scan saw the files that were there then: all but every third.
    totals = report.progress_totals(admitted, found, found.filter("file_seq % 3 <> 0"))
    return report.progress_rows(totals).select(
        "project_id", F.col("step").cast("long").alias("step"), "type", "message", "findings", "high"
    )
