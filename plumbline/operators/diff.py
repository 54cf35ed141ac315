"""Baselines and regression diffs. Finding ids are NOT unique, so these are semi and anti joins only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline import fixed_values as fv
from plumbline.operators import ranking
from plumbline.session import spread_by_key, stage

COMPARED = ["severity", "confidence", "asvs_category", "title", "file", "line", "detail", "remediation"]


def latest_baseline(scans: DataFrame) -> DataFrame:
    """Newest scan per (installation, repo) that is not a pull request; a null key never matches.

    ``max_by`` reduces a busy repo before the shuffle, which a ranking window would not.
    """
    return (
        scans.filter(~F.col("is_pull_request") & F.col("installation_id").isNotNull() & F.col("repo").isNotNull())
        .groupBy("installation_id", "repo")
        .agg(F.max_by("scan_id", F.struct("created_at", "scan_id")).alias("baseline_scan_id"))
    )


def baseline_history(scans: DataFrame, bound: int = ranking.BOUND) -> DataFrame:
    """``baseline_scan_id`` of every scan: the latest default-branch scan strictly before it."""
    keyed = F.col("installation_id").isNotNull() & F.col("repo").isNotNull()
    replayed = ranking.last_before(
        scans.filter(keyed), ["installation_id", "repo"], [F.col("created_at"), F.col("scan_id")],
        F.when(~F.col("is_pull_request"), F.col("scan_id")), "baseline_scan_id", bound,
    )
    unkeyed = scans.filter(~keyed).withColumn("baseline_scan_id", F.lit(None).cast("long"))
    return replayed.unionByName(unkeyed)


def new_findings(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Findings of each scan whose id its baseline lacks; ``pairs(scan_id, baseline_scan_id)``."""
    known = findings.select(F.col("scan_id").alias("baseline_scan_id"), "id").distinct()
    current = findings.join(pairs.select("scan_id", "baseline_scan_id"), "scan_id")
    return current.join(known, ["baseline_scan_id", "id"], "left_anti").drop("baseline_scan_id")


def _of_baseline(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    based = pairs.filter(F.col("baseline_scan_id").isNotNull()).select(
        F.col("scan_id").alias("for_scan"), F.col("baseline_scan_id").alias("scan_id")
    )
    return findings.join(based, "scan_id").drop("scan_id").withColumnRenamed("for_scan", "scan_id")


def carried_findings(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """The baseline's rows that are still present, with the baseline's multiplicity and enrichment.

    One step only: ``findings`` holds the baseline as it was persisted. ``persisted_posture`` takes whole histories.
    """
    current = findings.select("scan_id", "id").distinct()
    return _of_baseline(findings, pairs).join(current, ["scan_id", "id"], "left_semi")


def resolved_findings(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    current = findings.select("scan_id", "id").distinct()
    return _of_baseline(findings, pairs).join(current, ["scan_id", "id"], "left_anti")


def persisted_posture(findings: DataFrame, scans: DataFrame, bound: int = ranking.BOUND) -> DataFrame:
    """The persisted set of every scan, as a bag: new findings and carried-over ones, with ``status``.

    Carried rows are those of ``origin_scan_id``, the scan that began the unbroken run of default-branch scans
    with that id, so they keep its multiplicity and enrichment. A persisted set has the ids of its own scan;
    nothing is folded scan by scan. The default-branch scans of a repository are numbered; ``turn`` is a scan's own
    number, or for a pull request that of its baseline. Along (repository, id) a run is unbroken while turns follow
    each other by one, so both ordered passes over an id share one shuffle and one sort.
    """
    repo = ["installation_id", "repo"]
    keyed = F.col("installation_id").isNotNull() & F.col("repo").isNotNull()
    default = ~F.col("is_pull_request")
    place = scans.filter(keyed).select("scan_id", *repo, "created_at", "is_pull_request")
    hot = ranking.hot_keys(place, repo, bound)
    # The numbers 1, 2, ... of default-branch scans; a pull request stands behind the last one before it.
    own = ranking.row_number(place.filter(default), repo, [F.col("created_at"), F.col("scan_id")], "turn", hot=hot)
    pulls = place.filter(~default).withColumn("turn", F.lit(None).cast("long"))
    timeline = stage(ranking.last_before(
        own.unionByName(pulls), repo, [F.col("created_at"), F.col("scan_id")], F.col("turn"), "before", hot=hot
    ).select("scan_id", *repo, "is_pull_request", F.coalesce("turn", "before", F.lit(0)).alias("turn")))
    present = stage(findings.select("scan_id", "id").distinct().join(timeline, "scan_id", "left"))
    keys = [*repo, "id"]
    # Null-keyed scans have no baseline: all their findings are new.
    marked = present.filter("repo IS NOT NULL")
    if hot is None:
        marked = spread_by_key(marked, *keys)
    order = [F.col("turn"), F.col("is_pull_request"), F.col("scan_id")]
    seen = ranking.last_before(marked, keys, order, F.when(default, F.col("turn")), "__seen", hot=hot)
    expected = F.when(default, F.col("turn") - 1).otherwise(F.col("turn"))
    fresh = ~F.col("__seen").eqNullSafe(expected)
    runs = ranking.last_before(
        seen.withColumn("__new", fresh), keys, order, F.when(default & F.col("__new"), F.col("scan_id")), "__began", hot=hot)
    status = F.when(F.col("__new"), "new").otherwise("carried").alias("status")
    origin = F.when(F.col("__new"), F.col("scan_id")).otherwise(F.col("__began")).alias("origin_scan_id")
    alone = present.filter("repo IS NULL").select("scan_id", "id", F.lit("new").alias("status"), F.col("scan_id").alias("origin_scan_id"))
    origins = runs.select("scan_id", "id", status, origin).unionByName(alone)
    return findings.withColumnRenamed("scan_id", "origin_scan_id").join(origins, ["origin_scan_id", "id"])


def diff_against_baseline(current: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two finding sets side by side: ``status`` is new, carried or resolved."""
    on = [*keys, "id"]
    before, now = baseline.select(*on).distinct(), current.select(*on).distinct()
    return (
        current.join(before, on, "left_anti").withColumn("status", F.lit("new"))
        .unionByName(baseline.join(now, on, "left_semi").withColumn("status", F.lit("carried")))
        .unionByName(baseline.join(now, on, "left_anti").withColumn("status", F.lit("resolved")))
    )


def compare_sets(left: DataFrame, right: DataFrame, columns: Sequence[str] = COMPARED) -> DataFrame:
    """Multiset difference both ways: empty exactly when the two sets are equal row for row."""
    a, b = left.select(*columns), right.select(*columns)
    return (
        a.exceptAll(b).withColumn("side", F.lit("left"))
        .unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
    )


def latest_scan_per_user(scans: DataFrame) -> DataFrame:
    row = F.struct(*scans.columns)
    return scans.groupBy("user_id").agg(F.max_by(row, F.struct("created_at", "scan_id")).alias("s")).select("s.*")


def recent_scans(scans: DataFrame, limit: int = fv.RECENT_SCANS) -> DataFrame:
    """Newest scans per user; Spark cuts every map task to ``limit`` rows per user before the shuffle."""
    newest = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("scan_id").desc())
    return scans.withColumn("position", F.row_number().over(newest)).filter(F.col("position") <= limit)


def scan_header(scans: DataFrame) -> DataFrame:
    """Display columns of a scan row."""
    return scans.withColumns(
        {
            "repo_label": F.coalesce("repo", F.lit("(unknown repo)")),
            "short_sha": F.substring("commit_sha", 1, 7),
            "enriched_label": F.when(F.col("ai_enriched"), "enriched").otherwise("findings only"),
        }
    )


def scan_chip(high_count: Column) -> Column:
    return F.when(high_count > 0, "high").otherwise("low")
