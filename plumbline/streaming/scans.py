"""Commits as a stream: scan, diff, gate, persist."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from plumbline.operators import diff, gate
from plumbline.operators.report import rule_order
from plumbline.operators.scan import FINDING_COLUMNS, scan_projects
from plumbline.session import stage
from plumbline.streaming.store import BatchStore

SCANS = (
    "scan_id bigint, installation_id bigint, repo string, is_pull_request boolean, created_at timestamp_ntz, "
    "findings_count bigint, high_count bigint, new_count bigint, would_block boolean, conclusion string"
)
FINDINGS = (
    "scan_id bigint, ord struct<check_no:int,phase:int,file_seq:bigint,step:int,pos:int>, id string, severity string, confidence string, asvs_category string, title string, "
    "file string, line int, detail string, remediation string, code_snippet string, status string"
)


def scan_step(store: BatchStore, load_files: Callable[[DataFrame], DataFrame], mode: str = "report-only"):
    """``load_files(commits)`` gives ``files`` with ``project_id`` = scan id as text.

    All commits of a micro-batch are scanned and diffed in one pass, however many follow each other in one
    repository. The stored baseline of each repository comes first in its order, whatever its time; the commits
    follow by ``created_at``.
    """
    columns = [c.split()[0] for c in FINDINGS.split(", ")]
    place = ["scan_id", "installation_id", "repo", "is_pull_request", "created_at"]

    def step(batch: DataFrame, number: int) -> None:
        commits = stage(batch)
        found = scan_projects(load_files(commits)).withColumn("scan_id", F.col("project_id").cast("long"))
        current = found.withColumn("ord", rule_order()).select("scan_id", "ord", *FINDING_COLUMNS[1:])
        based = diff.latest_baseline(store.read("scans", SCANS, before=number)).join(
            commits, ["installation_id", "repo"], "left_semi"
        )
        first = F.lit("0001-01-01 00:00:00").cast(commits.schema["created_at"].dataType)
        chain = commits.select(*place).unionByName(
            based.withColumnRenamed("baseline_scan_id", "scan_id")
            .withColumns({"is_pull_request": F.lit(False), "created_at": first}).select(*place)
        )
        before = store.read("scan_findings", FINDINGS, before=number).join(
            based.select(F.col("baseline_scan_id").alias("scan_id")), "scan_id", "left_semi"
        )
        rows = stage(current.select(*columns[:-1]).unionByName(before.select(*columns[:-1])))
        kept = diff.persisted_posture(rows, chain).join(commits.select("scan_id"), "scan_id", "left_semi")
        kept = store.write("scan_findings", number, kept.select(*columns))
        decided = gate.gate(kept.filter("status = 'new'"), ["scan_id"], mode, universe=commits)
        totals = kept.groupBy("scan_id").agg(
            F.count(F.lit(1)).alias("findings_count"), F.count_if(F.col("severity") == "HIGH").alias("high_count"),
            F.count_if(F.col("status") == "new").alias("new_count"),
        )
        done = (
            commits.select(*place)
            .join(totals, "scan_id", "left").fillna(0, ["findings_count", "high_count", "new_count"])
            .join(decided, "scan_id")
        )
        store.write("scans", number, done.select(*[c.split()[0] for c in SCANS.split(", ")]))

    return step
