"""Annotations, report bodies, report documents and request texts.

A scan may hold any number of findings. Numbering spreads hot keys; a body that is cut at N characters takes
only the findings that can reach those characters; documents come in pages, each of a fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F, types as T

from plumbline import fixed_values as fv
from plumbline.functions.keys import annotation_level, category_label, severity_rank
from plumbline.operators import ranking
from plumbline.operators.gate import gate, severity_count_columns

SEPARATOR = "\n\n---\n\n"
#: Groups in which the rows of a hot key are cut before its last task.
SALTS = 32
_SEPARATOR = SEPARATOR.replace("\n", "\\n")  # as a SQL literal spells it


def _tie(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in ("ord", "id", "detail") if c in df.columns]


def rule_order() -> Column:
    """The place of a finding in rule order; findings of a whole project have no file and come first."""
    return F.struct("check_no", "phase", "file_seq", "step", "pos")


def number_findings(
    findings: DataFrame, keys: Sequence[str], by_severity: bool = True, name: str = "position", bound: int = ranking.BOUND
) -> DataFrame:
    """1-based position per key: severity descending (stable) or plain order.

    ``ord`` is a number, or the struct ``rule_order``.
    """
    rank = 3 - severity_rank(F.col("severity"))
    order = [rank] if by_severity else []
    return ranking.row_number(findings, keys, [*order, *_tie(findings)], name, bound)


def annotations(findings: DataFrame, keys: Sequence[str], batch: int = fv.ANNOTATION_BATCH) -> DataFrame:
    """One row per annotation with its batch number; synthetic paths are dropped."""
    real = findings.filter(~F.col("file").startswith("("))
    numbered = number_findings(real, keys, by_severity=False)
    line = F.when(F.col("line") > 0, F.col("line")).otherwise(1)
    body = F.when(F.coalesce("detail", F.lit("")) != "", F.col("detail")).otherwise(F.col("title"))
    fix = F.when(F.coalesce("remediation", F.lit("")) != "", F.concat(F.lit("\n\nFix: "), "remediation")).otherwise("")
    title = F.concat(F.lit("["), "severity", F.lit("] "), "title")
    return numbered.select(
        *keys, "position", F.floor((F.col("position") - 1) / batch).alias("batch"),
        F.col("file").alias("path"), line.cast("long").alias("start_line"), line.cast("long").alias("end_line"),
        annotation_level(F.col("severity")).alias("annotation_level"),
        F.substring(title, 1, fv.ANNOTATION_TITLE_CHARS).alias("title"),
        F.substring(F.concat(body, fix), 1, fv.ANNOTATION_MESSAGE_CHARS).alias("message"),
    )


def location(line: Column) -> Column:
    return F.when(line != 0, F.concat("file", F.lit(":"), line.cast("string"))).otherwise(F.col("file"))


def rendered_finding() -> Column:
    """Markdown of one finding."""
    text = lambda name: F.coalesce(name, F.lit(""))
    fix = F.when(text("remediation") != "", F.concat(F.lit("\n**Fix:** "), "remediation")).otherwise("")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("### ["), "severity", F.lit("] "), "title"),
        F.concat(F.lit("`"), location(F.col("line")), F.lit("`  ·  "), "confidence"),
        F.lit(""), text("detail"), fix,
    )


def enriched_finding() -> Column:
    """Markdown of one analyzed finding, as the continuous-integration report shows it."""
    text = lambda name: F.coalesce(name, F.lit(""))
    shown = F.when(text("explanation") != "", F.col("explanation")).otherwise(text("detail"))
    steps = F.when(F.col("remediation_steps").isNotNull(), F.array_join("remediation_steps", " "))
    fix = F.coalesce(steps, text("remediation"))
    requirement = F.col("asvs_requirement.title")
    category = F.when(F.coalesce(requirement, F.lit("")) != "", requirement).otherwise(text("asvs_category"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("### ["), "severity", F.lit("] "), "title"),
        F.concat(F.lit("`"), location(F.col("line")), F.lit("`  ·  "), category, F.lit("  ·  "), "confidence"),
        F.lit(""), shown, F.when(fix != "", F.concat(F.lit("\n**Fix:** "), fix)).otherwise(""),
    )


def report_text(
    findings: DataFrame, keys: Sequence[str], rendered: Column | None = None, limit: int = fv.REPORT_TEXT_CHARS
) -> DataFrame:
    """Findings in severity order joined into one text per key, cut at ``limit`` characters.

    A finding takes part when it or the separator before it begins below the limit, by the sum of the lengths. Separators alone reach the limit
    after ``limit / 7`` findings, whatever ``rendered`` gives (null counts as empty), so every map task passes on at
    most so many of a key, and no larger group is ever assembled. The map tasks grow with the input: what they pass on
    of a key with more rows than ``SALTS`` times that is cut once more in ``SALTS`` groups, so that the last task sorts
    a number of rows that does not grow.
    """
    order = [3 - severity_rank(F.col("severity")), *_tie(findings)]
    reach = math.ceil(limit / len(SEPARATOR)) + 2
    hot = ranking.hot_keys(findings, keys, SALTS * reach)
    if hot is None:
        return _cut_text(findings, keys, order, reach, rendered, limit)
    salted = findings.join(hot, list(keys), "left_semi").withColumn("__salt", F.spark_partition_id() % SALTS)
    first = _first(salted, [*keys, "__salt"], order, reach).drop("__salt", "__position")
    plain = findings.join(hot, list(keys), "left_anti")
    return _cut_text(plain, keys, order, reach, rendered, limit).unionByName(_cut_text(first, keys, order, reach, rendered, limit))


def _first(findings: DataFrame, keys: Sequence[str], order: Sequence[Column], reach: int) -> DataFrame:
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return findings.withColumn("__position", position).filter(F.col("__position") <= reach)


def _cut_text(findings, keys, order, reach: int, rendered: Column | None, limit: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    shown = _first(findings, keys, order, reach).withColumn(
        "__md", F.coalesce(rendered_finding() if rendered is None else rendered, F.lit("")))
    before = F.sum(F.length("__md") + len(SEPARATOR)).over(window.rowsBetween(Window.unboundedPreceding, -1))
    reaching = shown.withColumn("__before", F.coalesce(before, F.lit(0))).filter(F.col("__before") < limit + len(SEPARATOR))
    joined = F.expr(f"listagg(__md, '{_SEPARATOR}') WITHIN GROUP (ORDER BY __position)")
    return reaching.groupBy(*keys).agg(F.substring(joined, 1, limit).alias("text"))


def _verdict(mode: str, fail_on: str) -> Column:
    blocked = fv.GATE_FAILED if mode == "enforce" else fv.GATE_REPORT_ONLY
    text = [t.replace("{fail_on}", fail_on) for t in (fv.GATE_PASSED, blocked)]
    return F.when(~F.col("would_block"), text[0]).otherwise(text[1])


_COUNTS = [s.lower() for s in fv.SEVERITIES]


def _title() -> Column:
    return F.format_string("%d high · %d medium · %d low", *_COUNTS[:3])


def _summary(verdict: Column) -> Column:
    return F.format_string("**%d high · %d medium · %d low · %d info**\n\n%s", *_COUNTS, verdict)


def render_report(
    findings: DataFrame, keys: Sequence[str], mode: str = "report-only", fail_on: str = "HIGH",
    universe: DataFrame | None = None,
) -> DataFrame:
    """Gate, title, summary and text per key; keys of ``universe`` without findings report none."""
    gates = gate(findings, keys, mode, fail_on, universe, with_counts=True)
    return gates.join(report_text(findings, keys), list(keys), "left").select(
        *keys, "would_block", "conclusion", _title().alias("title"), _summary(_verdict(mode, fail_on)).alias("summary"),
        F.coalesce("text", F.lit(fv.NO_FINDINGS)).alias("text"),
    )


def render_ci_report(
    findings: DataFrame, outcomes: DataFrame, keys: Sequence[str], fail_on: str = "HIGH"
) -> DataFrame:
    """The continuous-integration report over ALL findings of a run, with the enrichment outcome noted.

    ``outcomes(keys, enrichment, enrichment_error, request_error)`` has one row per run; ``findings`` are
    analyzed ones. The gate comes from the findings alone.
    """
    gates = gate(findings, keys, "enforce", fail_on, outcomes, with_counts=True)
    verdict = F.when(F.col("would_block"), fv.CI_GATE_FAILED.replace("{fail_on}", fail_on)).otherwise(
        fv.GATE_PASSED.replace("{fail_on}", fail_on)
    )
    joined = gates.join(outcomes, list(keys)).join(report_text(findings, keys, enriched_finding()), list(keys), "left")
    return joined.select(
        *keys, "conclusion", _title().alias("title"), F.concat(_summary(verdict), submission_note()).alias("summary"),
        F.coalesce("text", F.lit(fv.NO_FINDINGS)).alias("text"),
    )


def neutral_report(reason: Column | str, tool: str = fv.TOOL_NAME) -> Column:
    """The fixed body of a scan that did not complete."""
    why = reason if isinstance(reason, Column) else F.lit(reason)
    title, summary = fv.NEUTRAL_TITLE.replace("{tool}", tool), fv.NEUTRAL_SUMMARY.replace("{tool}", tool)
    return F.struct(
        F.lit(title).alias("title"), F.replace(F.lit(summary), F.lit("{reason}"), why).alias("summary"),
        F.lit(fv.NEUTRAL_TEXT).alias("text"),
    )


def check_results(reports: DataFrame, failed: DataFrame, keys: Sequence[str], tool: str = fv.TOOL_NAME) -> DataFrame:
    """Completion rows: the report, or the neutral body for keys in ``failed(keys, reason)``."""
    joined = reports.join(failed.select(*keys, "reason"), list(keys), "left")
    neutral = neutral_report(F.col("reason"), tool)
    broken = F.col("reason").isNotNull()
    pick = lambda name: F.when(broken, neutral[name]).otherwise(F.col(name)).alias(name)
    return joined.select(
        *keys, F.when(broken, "neutral").otherwise(F.col("conclusion")).alias("conclusion"),
        pick("title"), pick("summary"), pick("text"),
    )


def submission_note() -> Column:
    """Extra summary lines of the continuous-integration report for the three enrichment outcomes."""
    failed = F.replace(F.lit(fv.NOTE_REQUEST_FAILED), F.lit("{reason}"), F.col("request_error"))
    return (
        F.when(F.col("enrichment_error") == "subscription_required", fv.NOTE_SUBSCRIPTION)
        .when(F.col("enrichment") == "unavailable", fv.NOTE_UNAVAILABLE)
        .when(F.col("request_error").isNotNull(), failed)
        .otherwise("")
    )


def report_documents(
    findings: DataFrame, scanned: DataFrame, key: str = "project_id", page_size: int = 1000,
    tool: str = fv.TOOL_NAME, version: str = "0.1",
) -> DataFrame:
    """JSON report per key in pages of ``page_size`` findings; one page equals the plain document.

    ``findings`` carries ``ord``, its position in rule order. Every page repeats head and counts.
    """
    numbered = number_findings(findings, [key], by_severity=False)
    item = F.struct(
        "position",
        F.struct(
            "confidence", "line", "severity", category_label(F.col("asvs_category")).alias("asvs"), "title", "file",
            "detail", "remediation",
        ).alias("f"),
    )
    pages = (
        numbered.withColumn("page", F.floor((F.col("position") - 1) / page_size))
        .groupBy(key, "page")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
    )
    counts = findings.groupBy(key).agg(*[c.alias(s) for c, s in zip(severity_count_columns(), fv.SEVERITIES)])
    body = F.struct(
        F.lit(tool).alias("tool"), F.lit(version).alias("version"),
        F.struct("files", "code", "sql").alias("scanned"),
        F.struct(*[F.coalesce(s, F.lit(0)).alias(s) for s in fv.SEVERITIES]).alias("counts"),
        F.coalesce(F.transform("items", lambda i: i["f"]), F.expr("array()")).alias("findings"),
    )
    joined = scanned.join(counts, key, "left").join(pages, key, "left")
    return joined.select(
        key, F.coalesce("page", F.lit(0)).alias("page"), F.to_json(body, {"ignoreNullFields": "false"}).alias("json")
    )


def console_pages(
    findings: DataFrame, scanned: DataFrame, key: str = "project_id", page_size: int = 1000, tool: str = fv.TOOL_NAME
) -> DataFrame:
    """Plain-text report per key in severity order, in pages, with the head and the summary line apart."""
    entry = F.concat_ws(
        "\n",
        F.concat(F.lit("["), "severity", F.lit("] "), "title"),
        F.concat(
            F.lit("   "), location(F.col("line")), F.lit("  ·  "), category_label(F.col("asvs_category")),
            F.lit("  ·  "), "confidence",
        ),
        F.concat(F.lit("   "), "detail"), F.concat(F.lit("   Fix: "), "remediation"), F.lit(""),
    )
    pages = (
        number_findings(findings, [key])
        .withColumn("page", F.floor((F.col("position") - 1) / page_size))
        .withColumn("__entry", entry)
        .groupBy(key, "page")
        .agg(F.expr("listagg(__entry, '\\n') WITHIN GROUP (ORDER BY position)").alias("body"))
    )
    counts = findings.groupBy(key).agg(*severity_count_columns())
    names = ["high", "medium", "low", "info"]
    joined = scanned.join(counts, key, "left").join(pages, key, "left").fillna(0, names)
    return joined.select(
        key, F.coalesce("page", F.lit(0)).alias("page"),
        F.format_string(f"{tool}: scanned %d code + %d SQL files", "code", "sql").alias("head"),
        F.coalesce("body", F.lit(fv.CONSOLE_NOTHING)).alias("body"),
        F.format_string("Summary  %d high · %d medium · %d low · %d info", *names).alias("summary"),
    )


def _request_block(detail_first: bool) -> Column:
    """Text block of one finding in a request; ``position`` numbers it."""
    shown = F.when(F.col("line") != 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise("")
    code = F.coalesce("code_snippet", F.lit(""))
    requirement = F.concat("req_id", F.lit(" — "), "req_title")
    head = [
        F.concat(F.lit("--- Finding "), F.col("position").cast("string"), F.lit(" (id: "), "id", F.lit(") ---")),
        F.concat(F.lit("Title: "), "title"),
        F.concat(F.lit("Severity: "), "severity", F.lit("   Confidence: "), "confidence"),
        F.concat(F.lit("Location: "), "file", shown),
    ]
    detail = F.concat(F.lit("Scanner detail: "), "detail")
    tail = (
        [detail, F.concat(F.lit("ASVS requirement: "), requirement), F.concat(F.lit("ASVS text: "), "req_text")]
        if detail_first
        else [F.concat(F.lit("ASVS: "), requirement), detail]
    )
    fenced = F.when(code != "", F.concat(F.lit("Code:\n```\n"), code, F.lit("\n```\n"))).otherwise("")
    return F.concat(F.concat_ws("\n", *head, *tail), F.lit("\n"), fenced)


def _paged_text(findings, keys, block: Column, page_size: int) -> DataFrame:
    return (
        number_findings(findings, keys, by_severity=False)
        .withColumn("page", F.floor((F.col("position") - 1) / page_size))
        .withColumn("__block", block)
        .groupBy(*keys, "page")
        .agg(
            F.expr("listagg(__block, '\\n') WITHIN GROUP (ORDER BY position)").alias("__body"),
            F.count(F.lit(1)).alias("findings"),
        )
    )


def request_text(findings: DataFrame, keys: Sequence[str], page_size: int = 100) -> DataFrame:
    """Request text of a scan; ``findings`` carries ``req_id``, ``req_title`` and ``req_text``."""
    paged = _paged_text(findings, keys, _request_block(True), page_size)
    return paged.select(*keys, "page", "findings", F.concat(F.lit(fv.REQUEST_HEAD), "__body", F.lit(fv.REQUEST_FOOT)).alias("text"))


def area_request_text(findings: DataFrame, areas: DataFrame, keys: Sequence[str], page_size: int = 100) -> DataFrame:
    """Request text of each (scan, area) with findings; ``areas`` comes from ``area_posture``."""
    paged = _paged_text(findings, [*keys, "asvs_category"], _request_block(False), page_size)
    # Joined by the scan alone: the pages already lie so, and their texts are not shuffled again.
    head = F.format_string("ASVS area: %s (%s)\nFindings in this area: %d\n\n", "label", "chapter", "findings")
    named = areas.groupBy(*keys).agg(F.collect_list(F.struct(F.col("category").alias("__area"), head.alias("__head"))).alias("__heads"))
    own = F.filter("__heads", lambda a: a["__area"] == F.col("asvs_category"))
    return paged.join(named, list(keys)).select("*", F.inline(own)).select(
        *keys, "asvs_category", "page", "findings", F.concat("__head", "__body").alias("text")
    )


def progress_totals(
    admitted: DataFrame, findings: DataFrame, baseline: DataFrame, enriched: DataFrame | None = None, key: str = "project_id"
) -> DataFrame:
    """One row of totals per scanned project, as ``progress_rows`` takes it.

    ``admitted`` comes from ``admit_files``, ``findings`` from the scan of these files, and ``baseline`` holds the rows
    of the last scan. The persisted rows are the new findings and the baseline's rows that are still there.
    ``enriched`` lists the projects whose new findings got answers. Projects without findings report zeros.
    """
    files = admitted.groupBy(key).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("kind") == "code").alias("code"),
        F.count_if(F.col("kind") == "sql").alias("sql"), F.bool_or("truncated").alias("truncated"),
    )
    new = findings.join(baseline.select(key, "id").distinct(), [key, "id"], "left_anti")
    carried = baseline.join(findings.select(key, "id").distinct(), [key, "id"], "left_semi")
    rows = findings.select(key, "severity", F.lit("seen").alias("part"))
    for part, some in (("new", new), ("carried", carried)):
        rows = rows.union(some.select(key, "severity", F.lit(part)))
    stored = F.col("part") != "seen"
    totals = rows.groupBy(key).agg(
        F.count_if(~stored).alias("total"), F.count_if(F.col("part") == "new").alias("new"),
        F.count_if(stored).alias("persisted"), F.count_if(stored & (F.col("severity") == "HIGH")).alias("high"),
    )
    joined = files.join(totals, key, "left").fillna(0, ["total", "new", "persisted", "high"])
    if enriched is None:
        return joined.withColumn("ai_enriched", F.lit(False))
    answered = enriched.select(key, F.lit(True).alias("__answered")).distinct()
    return joined.join(answered, key, "left").withColumn("ai_enriched", F.col("__answered").isNotNull() & (F.col("new") > 0)).drop("__answered")


def progress_rows(projects: DataFrame) -> DataFrame:
    """Progress feed of a scan: counts only, never file contents. Input: one row of totals per project."""
    plural = lambda n: F.when(F.col(n) == 1, "").otherwise("s")
    capped = F.when(F.col("truncated"), " (file cap reached)").otherwise("")
    log = lambda *parts: F.struct(
        F.lit("log").alias("type"), F.concat(*parts).alias("message"), F.lit(None).cast("long").alias("findings"),
        F.lit(None).cast("long").alias("high"), F.lit(None).cast("boolean").alias("ai_enriched"),
    )
    text = lambda n: F.col(n).cast("string")
    done = F.struct(
        F.lit("done").alias("type"), F.lit(None).cast("string").alias("message"),
        F.col("persisted").cast("long").alias("findings"), F.col("high").cast("long").alias("high"),
        F.col("ai_enriched").alias("ai_enriched"),
    )
    steps = F.array(
        log(F.lit("Downloaded "), text("files"), F.lit(" scannable file"), plural("files"), capped, F.lit(".")),
        log(
            F.lit("Scanned "), text("code"), F.lit(" code + "), text("sql"), F.lit(" SQL files — "),
            text("total"), F.lit(" finding"), plural("total"), F.lit(" total."),
        ),
        log(text("new"), F.lit(" new since last scan.")),
        done,
    )
    return projects.select("project_id", F.posexplode(steps).alias("step", "p")).select("project_id", "step", "p.*")


def observe_progress(findings: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """Totals collected while ``findings`` is written anyway; read them from the observation afterwards."""
    seen = Observation(name)
    high = F.count_if(F.col("severity") == "HIGH")
    return findings.observe(seen, F.count(F.lit(1)).alias("findings"), high.alias("high")), seen
