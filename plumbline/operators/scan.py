"""Files of many projects in, findings out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from plumbline import fixed_values as fv
from plumbline.functions.keys import finding_id
from plumbline.functions.paths import classify_file, is_ignored_path, normalize_path
from plumbline.operators import ranking
from plumbline.operators.rules import DEFAULT_RULES, NO_SQL, Rule, facts_of_file
from plumbline.session import stage

FINDING_COLUMNS = [
    "project_id", "id", "severity", "confidence", "asvs_category", "title", "file", "line", "detail",
    "remediation", "code_snippet",
]
ORDER_COLUMNS = ["check_no", "phase", "file_seq", "step", "pos"]
_PROJECT_FACTS = {"created_table", "open_entry_point", "header_config"}


def classify(files: DataFrame) -> DataFrame:
    """Normal path, ignored files dropped, ``kind`` added."""
    return (
        files.withColumn("path", normalize_path(F.col("path")))
        .filter(~is_ignored_path(F.col("path")))
        .withColumn("kind", classify_file(F.col("path")))
    )


def admit_files(
    files: DataFrame, max_bytes: int = fv.MAX_FILE_BYTES, max_files: int = fv.MAX_PROJECT_FILES, bound: int = ranking.BOUND
) -> DataFrame:
    """Scannable files up to the size limit, the first ``max_files`` per project, with ``truncated``.

    Only projects above the limit are numbered, and the last admitted ``file_seq`` of each of them is joined back.
    There are at most files / ``max_files`` of these, so the planner mostly broadcasts them and the contents stay
    where they are; beyond the broadcast threshold contents are shuffled by project, and AQE splits a hot one.
    """
    scannable = classify(files).filter(
        F.col("kind").isNotNull() & (F.octet_length("content") <= max_bytes)
    )
    places = stage(scannable.select("project_id", "file_seq"))
    crowded = places.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_files)
    numbered = ranking.row_number(
        places.join(crowded.select("project_id"), "project_id", "left_semi"), ["project_id"], [F.col("file_seq")], "__rn", bound,
    )
    last = stage(numbered.filter(F.col("__rn") == max_files).select("project_id", F.col("file_seq").alias("__last")))
    joined = scannable.join(last, "project_id", "left")
    inside = F.col("__last").isNull() | (F.col("file_seq") <= F.col("__last"))
    return joined.filter(inside).withColumn("truncated", F.col("__last").isNotNull()).drop("__last")


def scanned_counts(files: DataFrame) -> DataFrame:
    """Files, code files and SQL files per project after the ignore filter; reads paths only."""
    kind = classify_file(normalize_path(F.col("path")))
    kept = ~is_ignored_path(normalize_path(F.col("path")))
    return files.groupBy("project_id").agg(
        F.count_if(kept).alias("files"),
        F.count_if(kept & (kind == "code")).alias("code"),
        F.count_if(kept & (kind == "sql")).alias("sql"),
    )


def file_facts(files: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """The one pass over file contents: a map-only job without any shuffle."""
    found = facts_of_file(rules)
    scopes = sorted({r.scope for r in rules})
    return (
        classify(files)
        .filter(F.col("kind").isin(scopes))
        .select("project_id", "file_seq", "path", F.explode(found).alias("f"))
        .select("project_id", "file_seq", "path", "f.*")
    )


def _unsecured_tables(facts: DataFrame) -> DataFrame:
    """Created tables whose bare name no file of the project secures, at their first location.

    One aggregation by (project, table), partial before the shuffle; no join.
    """
    place = F.struct("file_seq", "pos", "path", "line", "check_no", "phase", "step")
    created = F.col("fact") == "B.created"
    return (
        facts.filter(F.col("fact").isin("B.created", "B.secured"))
        .groupBy("project_id", "arg")
        .agg(F.min(F.when(created, place)).alias("at"), F.bool_or(F.col("fact") == "B.secured").alias("secured"))
        .filter(F.col("at").isNotNull() & ~F.col("secured"))
        .select("project_id", "arg", F.lit("B1").alias("fact"), "at.*")
    )


def _first_header_config(facts: DataFrame) -> DataFrame:
    place = F.struct("file_seq", "pos", "path", "line", "check_no", "phase", "step", F.col("arg").alias("state"))
    return (
        facts.filter(F.col("fact") == "D.config")
        .groupBy("project_id")
        .agg(F.min(place).alias("at"))
        .filter(F.col("at.state") == "missing")
        .select("project_id", F.lit(None).cast("string").alias("arg"), F.lit("D").alias("fact"), "at.*")
        .drop("state")
    )


def _projects_without_sql(files: DataFrame) -> DataFrame:
    path = normalize_path(F.col("path"))
    return (
        files.groupBy("project_id")
        .agg(F.max(~is_ignored_path(path) & F.coalesce(classify_file(path) == "sql", F.lit(False))).alias("any_sql"))
        .filter(~F.col("any_sql"))
        .select(
            "project_id", F.lit(None).cast(files.schema["file_seq"].dataType).alias("file_seq"),
            F.lit(fv.PROJECT_FILE).alias("path"),
            F.lit("B0").alias("fact"), F.lit(2).alias("check_no"), F.lit(0).alias("phase"),
            F.lit(0).alias("step"), F.lit(0).alias("pos"), F.lit(None).cast("int").alias("line"),
            F.lit(None).cast("string").alias("arg"),
        )
    )


def describe(facts: DataFrame, rules: Sequence[Rule], tool: str = fv.TOOL_NAME) -> DataFrame:
    """Attach texts and the id; ``facts`` carries ``guarded`` where a middleware guard exists."""
    entries = []
    for code, text in dict(t for r in rules for t in r.texts).items():
        fields = ["severity", "asvs_category", "confidence", "title", "detail", "remediation"]
        values = [F.lit(v.replace("{tool}", tool)).alias(f) for f, v in zip(fields, text)]
        entries += [F.lit(code), F.struct(*values)]
    text = F.try_element_at(F.create_map(*entries), F.col("fact"))
    filled = lambda c: F.replace(c, F.lit("{arg}"), F.coalesce(F.col("arg"), F.lit("")))
    caveat = F.when((F.col("fact") == "C") & F.col("guarded"), fv.MIDDLEWARE_CAVEAT).otherwise("")
    return (
        facts.withColumn("t", text)
        .withColumn("title", filled(F.col("t.title")))
        .select(
            "project_id",
            finding_id(F.col("path"), F.col("title"), F.col("line")).alias("id"),
            "t.severity", "t.confidence", "t.asvs_category", "title", F.col("path").alias("file"), "line",
            F.concat(filled(F.col("t.detail")), caveat).alias("detail"),
            filled(F.col("t.remediation")).alias("remediation"),
            F.lit(None).cast("string").alias("code_snippet"),
            F.col("fact").alias("rule"), *ORDER_COLUMNS,
        )
    )


def apply_rules(
    files: DataFrame, rules: Sequence[Rule] = (*DEFAULT_RULES, NO_SQL), tool: str = fv.TOOL_NAME
) -> DataFrame:
    """Findings of all projects in the fixed rule order given by ``ORDER_COLUMNS``.

    With project-level rules the small facts are staged once, so the contents are never read twice.
    """
    content_rules = [r for r in rules if r.scope != "project"]
    names = {r.name for r in rules}
    parts = []
    marked = None
    if content_rules:
        facts = file_facts(files, content_rules)
        if names & _PROJECT_FACTS:
            facts = stage(facts)
        direct = facts.filter(~F.col("fact").contains("."))
        if "middleware_guard" in names:
            # Only entry points take part in the join with the guarded projects.
            guarded = facts.filter(F.col("fact") == "C.middleware").select("project_id").distinct()
            parts.append(direct.filter(F.col("fact") != "C"))
            marked = direct.filter(F.col("fact") == "C").join(
                guarded.withColumn("guarded", F.lit(True)), "project_id", "left"
            )
        else:
            parts.append(direct)
        if "created_table" in names:
            parts.append(_unsecured_tables(facts))
        if "header_config" in names:
            parts.append(_first_header_config(facts))
    if "no_sql" in names:
        parts.append(_projects_without_sql(files))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = found.withColumn("guarded", F.lit(False))
    if marked is not None:
        found = found.unionByName(marked.withColumn("guarded", F.coalesce("guarded", F.lit(False))))
    return describe(found, rules, tool)


def scan_projects(
    files: DataFrame, rules: Sequence[Rule] = (*DEFAULT_RULES, NO_SQL), tool: str = fv.TOOL_NAME
) -> DataFrame:
    """``files(project_id, file_seq, path, content)`` → findings of every project.

    ``file_seq`` orders the files of a project; any orderable type will do.
    """
    return apply_rules(files, rules, tool)
