"""SQL forms of the derived views and of the scan, for the side-by-side check."""

from __future__ import annotations

from plumbline import fixed_values as fv
from plumbline.plans import views


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def lits(values) -> str:
    return ", ".join(lit(v) for v in values)


FILES = f"""files AS (
  SELECT source AS project_id, doc_id AS file_seq,
    CASE WHEN source IN ({lits(views.QUIET_PROJECTS)}) AND (doc_id // 20) % 16 IN (3, 4, 13)
         THEN 'notes/n' || doc_id || '.txt'
         ELSE replace([{lits(views.PATHS)}][CAST((doc_id // 20) % 16 AS INT) + 1], '{{n}}', CAST(doc_id AS VARCHAR)) END AS path,
    text || chr(10) || replace([{lits(views.SNIPPETS)}][CAST((doc_id // 7) % {len(views.SNIPPETS)} AS INT) + 1],
         '{{n}}', CAST(doc_id AS VARCHAR)) || chr(10) AS content
  FROM documents)"""

CLASSIFIED = f"""named AS (
  SELECT project_id, file_seq, content, regexp_replace(replace(path, '\\', '/'), '^\\./', '') AS path FROM files),
parted AS (SELECT *, regexp_extract(path, '[^/]*$') AS base FROM named),
classified AS (
  SELECT * EXCLUDE (ext), CASE WHEN ext IN ({lits(fv.CODE_EXTENSIONS)}) THEN 'code' WHEN ext = '.sql' THEN 'sql' END AS kind
  FROM (SELECT *, CASE WHEN regexp_matches(base, '^.+\\.[^.]*$') THEN regexp_extract(base, '\\.[^.]*$') ELSE '' END AS ext
        FROM parted)
  WHERE NOT list_has_any(string_split(path, '/'), [{lits(fv.IGNORED_NAMES)}]))"""

# RE2 spellings of the patterns (no look-around; word boundaries are ASCII).
RX_AUTH = (
    r"\.auth\.getUser\s*\(|\.auth\.getSession\s*\(|getServerSession\s*\(|\bgetSession\s*\(|\bgetUser\s*\(|"
    r"\brequireUser\s*\(|\brequireAuth\s*\(|\bcurrentUser\s*\(|\bgetCurrentUser\s*\(|"
    r"\bverify(Jwt|Token|Session)\s*\(|withApiAuth|@clerk/"
)
RX_DATA = (
    r"\.from\s*\(\s*['\"`]|\bsupabase\b|\bprisma\s*\.|\bdrizzle\b|\bsql`|\bpool\.query\s*\(|"
    r"\bdb\.(select|insert|update|delete|query|execute)\b"
)
RX_URL = r"postgres(?:ql)?://([^\s'\"`:/@]+):([^\s'\"`@]+)@([^\s'\"`:/?]+)"
RX_CREATE = r"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?[\"'`]?(?:\w+\.)?(\w+)[\"'`]?"
RX_ENABLE = (
    r"(?i)alter\s+table\s+(?:if\s+exists\s+)?[\"'`]?(?:\w+\.)?(\w+)[\"'`]?\s+enable\s+row\s+level\s+security"
)
RX_HTML = r"dangerouslySetInnerHTML\s*=\s*\{\{[^}]*__html\s*:\s*([^}]+)\}\}"
RX_CREDS = [
    r"\bAKIA[0-9A-Z]{16}\b", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", r"\b[sr]k_live_[0-9a-zA-Z]{16,}\b",
    r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b",
]
RX_KEY = "-----BEGIN[A-Z ]*PRIVATE" + " KEY" + "-----"
_NL = "len({0}) - len(replace({0}, chr(10), ''))"


def every(code: str, kind: str, pattern: str, group: int = 0, arg: str = "NULL", where: str = "true", line_sql=None) -> str:
    """All matches with line numbers: newlines of the pieces before plus those of the earlier matches."""
    nl = "list_sum(list_transform({0}, lambda x: len(x) - len(replace(x, chr(10), ''))))"
    return f"""SELECT project_id, file_seq, path, {code} AS rule, i - 1 AS pos,
      1 + {nl.format("parts[1:i]")} + coalesce({nl.format("found[1:i-1]")}, 0) AS line, {arg} AS arg
    FROM (SELECT *, string_split_regex(content, {lit(pattern)}) AS parts,
                 regexp_extract_all(content, {lit(pattern)}, 0) AS found,
                 regexp_extract_all(content, {lit(pattern)}, {group}) AS groups FROM classified
          WHERE kind = {lit(kind)} AND regexp_matches(content, {lit(pattern)})) t, UNNEST(range(1, len(found) + 1)) AS r(i)
    WHERE {where}"""


def first(code: str, pattern: str, where: str, arg: str = "NULL", pos: int = 0) -> str:
    before = f"string_split_regex(content, {lit(pattern)})[1]"
    return f"""SELECT project_id, file_seq, path, {lit(code)} AS rule, {pos} AS pos,
      1 + {_NL.format(before)} AS line, {arg} AS arg
    FROM classified WHERE kind = 'code' AND {where} AND regexp_matches(content, {lit(pattern)})"""


_NAME = "groups[i]"
_URLS = f"""SELECT project_id, file_seq, path, 'A3' AS rule, i - 1 AS pos,
      1 + list_sum(list_transform(parts[1:i], lambda x: len(x) - len(replace(x, chr(10), '')))) AS line, NULL AS arg
    FROM (SELECT *, string_split_regex(content, {lit(RX_URL)}) AS parts,
                 regexp_extract_all(content, {lit(RX_URL)}, 2) AS pw, regexp_extract_all(content, {lit(RX_URL)}, 3) AS host
          FROM classified WHERE kind = 'code' AND contains(content, 'postgres')) t, UNNEST(range(1, len(pw) + 1)) AS r(i)
    WHERE NOT regexp_matches(host[i], '(?i)^(localhost|127\\.0\\.0\\.1|::1|0\\.0\\.0\\.0)$')
      AND NOT regexp_matches(pw[i], '(?i)^(placeholder|changeme|your[-_]?password|example|sample|dummy|x{{3,}})$')
      AND NOT regexp_matches(pw[i], '^[\\[<{{].*[\\]>}}]$')"""
_TIER = (
    "CASE WHEN regexp_matches(groups[i], '(?i)(SERVICE_ROLE|SECRET|PASSWORD|PRIVATE)') THEN 'A1' ELSE 'A1B' END"
)
_EXAMPLE = r"NOT regexp_matches(path, '(?i)(^|[./])(example|sample|template|fixture|mock)s?([./]|$)')"

RULE_SQL = {
    "public_variable": every(
        _TIER, "code", r"process\.env\.(NEXT_PUBLIC_[A-Z0-9_]+)", 1, _NAME,
        r"NOT regexp_matches(groups[i], '(?i)(ANON|PUBLISHABLE)') AND regexp_matches(groups[i], "
        r"'(?i)(SERVICE_ROLE|SECRET|PASSWORD|PRIVATE|_KEY$|_TOKEN$)')",
    ),
    "client_service_role": first(
        "A2", "SERVICE_ROLE|service_role", r"""regexp_matches(content, '(?m)^\s*[''"]use client[''"]')"""
    ),
    "database_url": _URLS,
    "permissive_policy": every("'B2'", "sql", r"(?i)(?:using|with\s+check)\s*\(\s*true\s*\)"),
    "created_table": f"""SELECT project_id, any_value(seq) AS file_seq, any_value(path) AS path, 'B1' AS rule, any_value(pos) AS pos,
      any_value(line) AS line, arg
    FROM (SELECT c.project_id, c.arg, first_value(c.file_seq) OVER w AS seq, first_value(c.path) OVER w AS path,
                 first_value(c.pos) OVER w AS pos, first_value(c.line) OVER w AS line
          FROM ({every("'B1'", "sql", RX_CREATE, 1, "lower(groups[i])")}) c
          WHERE NOT EXISTS (SELECT 1 FROM ({every("'x'", "sql", RX_ENABLE, 1, "lower(groups[i])")}) e
                            WHERE e.project_id = c.project_id AND e.arg = c.arg)
          WINDOW w AS (PARTITION BY c.project_id, c.arg ORDER BY c.file_seq, c.pos)) GROUP BY project_id, arg""",
    "open_entry_point": f"""SELECT project_id, file_seq, path, 'C' AS rule, 0 AS pos, 1 AS line,
      CASE WHEN regexp_matches(base, '^route\\.(t|j)sx?$') AND regexp_matches(path, '(^|/)app/') THEN 'Route handler'
           WHEN regexp_matches(path, '(^|/)pages/api/') THEN 'API route' ELSE 'Server action' END AS arg
    FROM classified WHERE kind = 'code' AND (regexp_matches(base, '^route\\.(t|j)sx?$') AND regexp_matches(path, '(^|/)app/')
        OR regexp_matches(path, '(^|/)pages/api/') OR regexp_matches(content, '(?m)^\\s*[''"]use server[''"]'))
      AND regexp_matches(content, {lit(RX_DATA)}) AND NOT regexp_matches(content, {lit(RX_AUTH)})""",
    "header_config": """SELECT project_id, file_seq, path, 'D' AS rule, 0 AS pos, 1 AS line, NULL AS arg
    FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY file_seq) AS rn FROM classified
          WHERE kind = 'code' AND regexp_matches(path, '(^|/)next\\.config\\.(js|ts|mjs|cjs)$'))
    WHERE rn = 1 AND NOT regexp_matches(content,
      'headers\\s*\\(\\s*\\)|headers\\s*:\\s*async|(?i:Content-Security-Policy)|(?i:Strict-Transport-Security)')""",
    "credential": "\n    UNION ALL ".join(
        [first("E1", p, _EXAMPLE, lit(label), n) for n, ((label, _), p) in enumerate(zip(fv.CREDENTIAL_FORMATS, RX_CREDS))]
        + [first("E2", RX_KEY, _EXAMPLE, pos=4)]
    ),
    "concatenated_sql": every(
        "'F'", "code", r"\.(?:query|execute|unsafe|raw)\s*\(\s*(?:`[^`]*\$\{|['\"][^'\"]*['\"]\s*\+)"
    ),
    "dynamic_execution": every("'G'", "code", r"\beval\s*\(|\bnew\s+Function\s*\("),
    "raw_html": every(
        "'H'", "code", RX_HTML, 1, "NULL",
        r"""NOT regexp_matches(groups[i], '^\s*[''"`]') AND NOT regexp_matches(groups[i], '(?i)sanitiz|dompurify|purify|escapehtml')""",
    ),
    "no_sql": """SELECT project_id, CAST(NULL AS BIGINT) AS file_seq, '(project)' AS path, 'B0' AS rule, 0 AS pos, NULL AS line, NULL AS arg
    FROM (SELECT DISTINCT project_id FROM files) p
    WHERE NOT EXISTS (SELECT 1 FROM classified c WHERE c.project_id = p.project_id AND c.kind = 'sql')""",
}


def _texts() -> str:
    rows = []
    for code, (sev, cat, conf, title, detail, fix) in fv.RULE_TEXT.items():
        cells = [code, sev, cat, conf, title, detail.replace("{tool}", fv.TOOL_NAME), fix]
        rows.append("(" + lits(cells) + ")")
    return "texts(rule, severity, asvs_category, confidence, title, detail, remediation) AS (VALUES " + ",\n  ".join(rows) + ")"


def findings_ctes(*rules: str) -> str:
    """CTEs ending in ``findings`` for the given rules (all when none is named)."""
    chosen = rules or tuple(RULE_SQL)
    hits = "\n  UNION ALL ".join(RULE_SQL[r] for r in chosen)
    return f"""{FILES},
{CLASSIFIED},
hits AS ({hits}),
{_texts()},
guarded AS (SELECT DISTINCT project_id FROM classified WHERE kind = 'code' AND base IN ('middleware.ts', 'middleware.js')
            AND regexp_matches(content, {lit(RX_AUTH)})),
titled AS (SELECT h.*, t.severity, t.asvs_category, t.confidence, t.remediation AS r, t.detail AS d,
             replace(t.title, '{{arg}}', coalesce(h.arg, '')) AS title FROM hits h JOIN texts t USING (rule)),
findings AS (SELECT project_id,
    'pf_' || substr(sha256(path || '|' || title || '|' || coalesce(CAST(line AS VARCHAR), '')), 1, 12) AS id,
    severity, confidence, asvs_category, title, path AS file, CAST(line AS BIGINT) AS line,
    replace(d, '{{arg}}', coalesce(arg, '')) || CASE WHEN rule = 'C' AND project_id IN (SELECT project_id FROM guarded)
      THEN {lit(fv.MIDDLEWARE_CAVEAT)} ELSE '' END AS detail,
    replace(r, '{{arg}}', coalesce(arg, '')) AS remediation, file_seq, rule, pos
  FROM titled)"""


# Check by check, project-level findings first, tables without row security after the other SQL findings.
RULE_ORDER = (
    "ascii(rule), rule = 'B1', file_seq NULLS FIRST, "
    "CASE WHEN rule = 'A2' THEN 1 WHEN rule = 'A3' THEN 2 WHEN rule LIKE 'E%' THEN pos ELSE 0 END, pos"
)

FINDING_SELECT = (
    "SELECT project_id, id, severity, confidence, asvs_category, title, file, line, detail, remediation FROM findings"
)


def findings_query(*rules: str) -> str:
    return f"WITH {findings_ctes(*rules)}\n{FINDING_SELECT}"


SCANS = """scans AS (SELECT o_orderkey AS scan_id, o_custkey AS user_id,
    CASE WHEN o_custkey % 10 = 0 THEN 'key' || o_custkey END AS api_key_id,
    CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS installation_id,
    CASE WHEN o_orderkey % 11 <> 0 THEN 'org/r' || (o_orderkey % 3) END AS repo,
    CASE WHEN o_orderstatus = 'P' THEN 'feature' ELSE 'refs/heads/main' END AS ref,
    substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 40) AS commit_sha,
    o_orderstatus = 'P' AS is_pull_request, o_orderpriority = '1-URGENT' AS ai_enriched, o_orderdate AS created_at
  FROM orders)"""

SCAN_FINDINGS = """scan_findings AS (SELECT *,
    'pf_' || substr(sha256(file || '|' || title || '|' || coalesce(CAST(line AS VARCHAR), '')), 1, 12) AS id
  FROM (SELECT l_orderkey AS scan_id, CAST(l_linenumber AS BIGINT) * 100000 + l_partkey % 100000 AS ord,
    CASE WHEN l_returnflag = 'A' AND l_linenumber <= 2 THEN 'HIGH' WHEN l_returnflag = 'R' THEN 'MEDIUM'
         WHEN l_linenumber <= 4 THEN 'LOW' WHEN l_suppkey % 13 = 0 THEN 'CRITICAL' ELSE 'INFO' END AS severity,
    CASE WHEN l_linestatus = 'O' THEN 'definitive' ELSE 'heuristic' END AS confidence,
    CASE WHEN l_partkey % 4 = 0 THEN 'ACCESS' WHEN l_partkey % 4 = 1 THEN 'SECRETS' WHEN l_partkey % 4 = 2 THEN 'CONFIG'
         WHEN l_suppkey % 9 = 0 THEN 'ASVS: Security Configuration' ELSE 'INJECTION' END AS asvs_category,
    'Rule ' || (l_partkey % 5) AS title,
    CASE WHEN l_partkey % 10 = 9 THEN '(project)' ELSE 'lib/f' || (l_partkey % 10) || '.ts' END AS file,
    CASE WHEN l_suppkey % 7 <> 0 THEN l_linenumber END AS line,
    'qty ' || CAST(l_quantity AS BIGINT) || ' part ' || l_partkey || ' supp ' || l_suppkey || ' ' || l_returnflag || l_linestatus AS detail,
    CASE WHEN l_partkey % 8 = 0 THEN '' ELSE 'Fix ' || (l_partkey % 5) END AS remediation,
    CASE WHEN l_suppkey % 5 = 0 THEN 'code ' || l_suppkey END AS code_snippet
  FROM lineitem))"""

RANK = "CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
REQUIREMENTS = "requirements(id, chapter, section, title, text) AS (VALUES " + ", ".join(
    "(" + lits(r) + ")" for r in fv.REQUIREMENTS
) + ")"
CATEGORY_REQUIREMENT = "category_requirement(category, ord, req_id) AS (VALUES " + ", ".join(
    f"({lit(c)}, {n}, {lit(i)})" for c, ids in fv.CATEGORY_REQUIREMENTS.items() for n, i in enumerate(ids)
) + ")"
AREAS = "areas(category, area_ord, label) AS (VALUES " + ", ".join(
    f"({lit(c)}, {n}, {lit(fv.AREA_LABEL[c])})" for n, c in enumerate(fv.CATEGORIES)
) + ")"

REPO_EVENTS = """repo_events AS (SELECT event_id AS seq, ts, user_id AS inst, event_type,
    'org' || (user_id % 20) || '/r' || (event_id % 3) AS name,
    CASE WHEN event_id % 50 <> 0 THEN (user_id % 20) * 10 + event_id % 3 + 1 END AS repo_id,
    CASE WHEN event_id % 37 = 0 THEN '0000000000' ELSE 'a' || (event_id // 2000) || 'x' || (event_id % 40) END AS sha,
    event_id % 53 <> 0 AS has_inst FROM events)"""
INSTALLATIONS = """installations AS (SELECT c_custkey AS installation_id, c_name AS account_login,
    CASE WHEN c_nationkey % 2 = 0 THEN 'User' ELSE 'Organization' END AS account_type, c_custkey + 1000000 AS user_id,
    CASE WHEN c_custkey % 13 = 0 THEN TIMESTAMP '2023-12-01 00:00:00' END AS suspended_at FROM customer WHERE c_custkey % 9 <> 0)"""
REQUESTS = f"""{REPO_EVENTS}, {INSTALLATIONS}, requests AS (
  SELECT r.seq, r.ts, r.inst AS installation_id, r.name AS repo_full_name, r.repo_id, r.sha AS head_sha,
    CASE WHEN event_type = 'click' THEN 'refs/heads/main' ELSE 'feat' || (seq % 2) END AS ref,
    event_type = 'view' AS is_pull_request, i.user_id
  FROM repo_events r JOIN installations i ON i.installation_id = r.inst AND i.suspended_at IS NULL
  WHERE has_inst AND repo_id IS NOT NULL AND (
    (event_type = 'click' AND seq % 5 <> 0 AND seq % 41 <> 0 AND sha <> '0000000000')
    OR (event_type = 'view' AND seq % 4 <> 2 AND seq % 11 <> 0 AND seq % 7 <> 0)))"""
SETUPS = """repo_setups AS (SELECT c_custkey + 1000000 AS user_id, c_custkey AS installation_id,
    'org' || (c_custkey % 20) || '/r' || (c_custkey % 3) AS repo_full_name, CASE WHEN c_custkey % 4 <> 0 THEN 'main' END AS default_branch,
    'created' AS workflow_state, ['set', 'pending'][CAST(c_custkey % 2 AS INT) + 1] AS secret_state, 'k' || c_custkey AS api_key_id,
    ['vercel', 'netlify', 'cloudflare', 'gone'][CAST((c_custkey // 2) % 4 AS INT) + 1] AS gate_provider,
    ['unverified', 'required', 'error'][CAST((c_custkey // 3) % 3 AS INT) + 1] AS gate_state,
    CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '2024-01-10 00:00:00' + to_minutes(c_custkey % 20) END AS gate_last_checked_at
  FROM customer WHERE c_custkey % 6 <> 0)"""
API_KEYS = """api_keys AS (SELECT 'k' || c_custkey AS id, c_custkey AS user_id, c_name AS name, 'pflt_tok' || c_custkey AS token,
    substr('pflt_tok' || c_custkey, 1, 13) AS key_prefix, TIMESTAMP '2023-01-01 00:00:00' + to_days(CAST(c_custkey % 300 AS INT)) AS created_at,
    CAST(NULL AS TIMESTAMP) AS last_used_at, CASE WHEN c_custkey % 11 = 0 THEN TIMESTAMP '2023-12-31 00:00:00' END AS revoked_at FROM customer)"""
USES = f"""{API_KEYS}, uses AS (SELECT event_id AS call_id, ts, k.id AS api_key_id, k.user_id
  FROM events e JOIN api_keys k ON k.token = 'pflt_tok' || e.user_id AND k.revoked_at IS NULL WHERE event_id % 6 IN (3, 4))"""
JOB_EVENTS = """job_events AS (SELECT 'j' || user_id || '-' || (event_id % 4) AS job_id, user_id % 25 AS installation_id,
    ['queued', 'claimed', 'failed', 'claimed', 'done', 'check_opened', 'failed', 'superseded'][CAST((event_id // 4) % 8 AS INT) + 1] AS event,
    event_id AS seq, ts, 'err ' || event_id AS error, event_id AS check_run_id FROM events)"""
JOBS = f"""{JOB_EVENTS}, moves AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn
    FROM job_events WHERE event <> 'check_opened'),
jobs AS (SELECT a.job_id, a.installation_id, a.created_at, a.attempts, a.claimed_at, a.check_run_id,
    CASE m.event WHEN 'claimed' THEN 'running' WHEN 'failed' THEN CASE WHEN attempts >= 5 THEN 'dead' ELSE 'error' END
      WHEN 'done' THEN 'done' WHEN 'superseded' THEN 'done' ELSE 'queued' END AS status,
    CASE WHEN m.event IN ('done', 'superseded') OR (m.event = 'failed' AND attempts >= 5) THEN m.ts END AS finished_at,
    CASE x.event WHEN 'failed' THEN x.error WHEN 'superseded' THEN 'superseded by ' || x.error END AS last_error
  FROM (SELECT job_id, arg_min(installation_id, seq) AS installation_id, min(ts) AS created_at,
          count(*) FILTER (event = 'claimed') AS attempts, arg_max(ts, seq) FILTER (event = 'claimed') AS claimed_at,
          arg_min(check_run_id, seq) FILTER (event = 'check_opened') AS check_run_id FROM job_events GROUP BY job_id) a
  LEFT JOIN moves m ON m.job_id = a.job_id AND m.rn = 1
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM job_events
             WHERE event IN ('failed', 'done', 'superseded')) x ON x.job_id = a.job_id AND x.rn = 1)"""
BACKLOG = f"""{JOBS}, backlog AS (SELECT * FROM (SELECT *, CASE WHEN status = 'queued' THEN 'queued'
    WHEN status = 'error' AND attempts < 5 AND claimed_at + to_seconds(30 * pow(2, least(attempts, 6))) < TIMESTAMP '2024-01-30 12:00:00' THEN 'retry'
    WHEN status = 'running' AND claimed_at + to_seconds(600) < TIMESTAMP '2024-01-30 12:00:00'
      THEN CASE WHEN attempts < 5 THEN 'lease_expired' ELSE 'stuck' END END AS reason FROM jobs) WHERE reason IS NOT NULL)"""
BILLING = """deliveries AS (
  SELECT 'evt_' || event_id AS id, event_id AS n, user_id, ts AS created, event_id AS arrival_seq, event_id % 6 AS st FROM events
  UNION ALL SELECT 'evt_' || event_id, event_id, user_id, ts, event_id + 1000000000, (event_id + 1) % 6 FROM events WHERE event_id % 10 = 0),
first_seen AS (SELECT * FROM deliveries QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival_seq) = 1),
patches AS (SELECT id, n, 'cus_' || user_id AS customer_id, 'sub_' || user_id AS subscription_id, created, arrival_seq,
    ['active', 'trialing', 'past_due', 'canceled', 'unpaid', 'incomplete'][CAST(st AS INT) + 1] AS status,
    CASE WHEN n % 4 <> 0 THEN 'price_' || (n % 3) END AS price_id, make_timestamp((1700000000 + n) * 1000000) AS current_period_end
  FROM first_seen WHERE n % 8 <> 7 AND n % 29 <> 0 AND n % 31 <> 0),
subs AS (SELECT c_custkey AS user_id, 'cus_' || c_custkey AS stripe_customer_id FROM customer WHERE c_custkey % 7 <> 0),
state AS (SELECT s.user_id, s.stripe_customer_id, p.subscription_id AS stripe_subscription_id, coalesce(p.status, 'incomplete') AS status,
    p.price_id, p.current_period_end FROM subs s LEFT JOIN (SELECT * FROM patches
      QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY {order} DESC) = 1) p ON p.customer_id = s.stripe_customer_id)"""
