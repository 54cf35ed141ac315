"""Queries over files: path functions, admission, every rule, the whole scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed_values as fv
from plumbline.functions import paths
from plumbline.functions.text import contains_any
from plumbline.operators import report
from plumbline.operators.rules import Rule, every_match, rules_named
from plumbline.operators.scan import admit_files, apply_rules, classify, scan_projects, scanned_counts
from plumbline.plans import oracle as o
from plumbline.plans import query
from plumbline.session import stage


def _shown(findings):
    return findings.select(
        "project_id", "id", "severity", "confidence", "asvs_category", "title", "file",
        F.col("line").cast("long").alias("line"), "detail", "remediation",
    )


_RULE_SETS = {
    "rule_public_variable": ["public_variable"],
    "rule_client_service_role": ["client_service_role"],
    "rule_database_url": ["database_url"],
    "rule_no_sql": ["no_sql"],
    "rule_table_without_row_security": ["created_table", "row_security"],
    "rule_permissive_policy": ["permissive_policy"],
    "rule_open_entry_point": ["open_entry_point", "middleware_guard"],
    "rule_header_config": ["header_config"],
    "rule_credentials": ["credential"],
    "rule_concatenated_sql": ["concatenated_sql"],
    "rule_dynamic_execution": ["dynamic_execution"],
    "rule_raw_html": ["raw_html"],
}


def _register_rule(name: str, rules: list[str]) -> None:
    sql = o.findings_query(*[r for r in rules if r in o.RULE_SQL])

    @query(name, sql)
    def plan(t):
        return _shown(apply_rules(t.files(), rules_named(*rules)))


for _name, _rules in _RULE_SETS.items():
    _register_rule(_name, _rules)


@query("scan_projects", o.findings_query())
def _scan(t):
    return _shown(scan_projects(t.files()))


@query(
    "scan_in_rule_order",
    f"WITH {o.findings_ctes()} SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY {o.RULE_ORDER}) AS place, "
    "rule, file, line, title FROM findings",
)
def _scan_order(t):
    found = stage(scan_projects(t.files()).withColumn("ord", report.rule_order()))
    return report.number_findings(found, ["project_id"], by_severity=False, name="place").select(
        "project_id", "place", "rule", "file", F.col("line").cast("long").alias("line"), "title"
    )


_EXPORTED = r"export const (\w+)"


@query(
    "scan_with_own_rule",
    f"""WITH {o.FILES}, {o.CLASSIFIED}, hits AS ({o.every("'X1'", "code", _EXPORTED, 1, "groups[i]")})
    SELECT project_id, 'pf_' || substr(sha256(path || '|Exported constant ' || arg || '|' || line), 1, 12) AS id, rule, path AS file,
      CAST(line AS BIGINT) AS line, 'Exported constant ' || arg AS title FROM hits""",
)
def _own_rule(t):
    """A rule of the user's own, registered beside the built-in ones."""
    texts = (("X1", ("INFO", "CONFIG", "definitive", "Exported constant {arg}", "Exports {arg}.", "")),)
    own = Rule("exported_constant", "code", every_match("X1", 9, _EXPORTED, 1), contains_any(["export const"]), texts)
    found = apply_rules(t.files(), (*rules_named("dynamic_execution"), own)).filter("rule = 'X1'")
    return found.select("project_id", "id", "rule", "file", F.col("line").cast("long").alias("line"), "title")


@query(
    "classify_files",
    f"WITH {o.FILES}, {o.CLASSIFIED} SELECT project_id, file_seq, path, base, kind, "
    "regexp_matches(path, '(?i)(^|[./])(example|sample|template|fixture|mock)s?([./]|$)') AS example FROM classified",
)
def _classify(t):
    path = F.col("path")
    return classify(t.files()).select(
        "project_id", "file_seq", "path", paths.basename(path).alias("base"), "kind",
        paths.is_example_file(path).alias("example"),
    )


@query(
    "scannable_paths",
    f"WITH {o.FILES}, {o.CLASSIFIED} SELECT f.project_id, f.file_seq, f.path, c.kind IS NOT NULL AS scannable "
    "FROM files f LEFT JOIN classified c USING (file_seq)",
)
def _scannable(t):
    return t.files().select(
        "project_id", "file_seq", "path", paths.is_scannable_path(F.col("path")).alias("scannable")
    )


@query(
    "scanned_counts",
    f"WITH {o.FILES}, {o.CLASSIFIED} SELECT p.project_id, count(c.path) AS files, "
    "count(*) FILTER (c.kind = 'code') AS code, count(*) FILTER (c.kind = 'sql') AS sql "
    "FROM files p LEFT JOIN classified c USING (file_seq) GROUP BY p.project_id",
)
def _scanned_counts(t):
    return scanned_counts(t.files())


@query(
    "admitted_files",
    f"WITH {o.FILES}, {o.CLASSIFIED}, ranked AS (SELECT project_id, file_seq, path, kind, strlen(content) AS bytes, "
    "row_number() OVER (PARTITION BY project_id ORDER BY file_seq) AS rn, "
    "count(*) OVER (PARTITION BY project_id) > 20 AS truncated "
    "FROM classified WHERE kind IS NOT NULL AND strlen(content) <= 20000) "
    "SELECT project_id, file_seq, path, kind, CAST(bytes AS BIGINT) AS bytes, truncated FROM ranked WHERE rn <= 20",
)
def _admitted(t):
    return admit_files(t.files(), max_bytes=20000, max_files=20).select(
        "project_id", "file_seq", "path", "kind",
        F.octet_length("content").cast("long").alias("bytes"), "truncated",
    )


@query(
    "severity_by_project",
    f"WITH {o.findings_ctes()} SELECT project_id, " + ", ".join(
        f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in fv.SEVERITIES
    ) + ", bool_or(severity = 'HIGH') AS cli_fails FROM findings GROUP BY project_id",
)
def _severity(t):
    from plumbline.operators.gate import cli_gate, severity_counts

    found = scan_projects(t.files())
    counts = severity_counts(found, ["project_id"])
    return counts.join(cli_gate(found, ["project_id"]), "project_id")
