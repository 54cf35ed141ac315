"""Severity counts and gate decisions: one partial aggregation each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import fixed_values as fv
from plumbline.functions.keys import severity_rank


def severity_count_columns() -> list[Column]:
    """Zero-filled counts of the four levels; unknown severities count nowhere."""
    return [F.count_if(F.col("severity") == s).alias(s.lower()) for s in fv.SEVERITIES]


def severity_counts(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    return findings.groupBy(*keys).agg(*severity_count_columns())


def threshold(fail_on: str) -> int:
    """Rank of a threshold; an unknown one means HIGH."""
    return fv.SEVERITY_RANK.get(fail_on.upper(), fv.SEVERITY_RANK["HIGH"])


def conclusion(would_block: Column, mode: str) -> Column:
    return F.when(~would_block, "success").otherwise("failure" if mode == "enforce" else "neutral")


def gate(
    findings: DataFrame, keys: Sequence[str], mode: str = "report-only", fail_on: str = "HIGH",
    universe: DataFrame | None = None, with_counts: bool = False,
) -> DataFrame:
    """``would_block`` and ``conclusion`` per key; keys of ``universe`` without findings succeed.

    ``with_counts`` adds the severity counts out of the same aggregation.
    """
    blocks = (F.max(severity_rank(F.col("severity"))) >= threshold(fail_on)).alias("would_block")
    decided = findings.groupBy(*keys).agg(blocks, *(severity_count_columns() if with_counts else []))
    if universe is not None:
        decided = universe.select(*keys).join(decided, list(keys), "left")
    if with_counts:
        decided = decided.fillna(0, [s.lower() for s in fv.SEVERITIES])
    blocked = F.coalesce("would_block", F.lit(False))
    return decided.withColumn("would_block", blocked).withColumn("conclusion", conclusion(blocked, mode))


def cli_gate(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The command-line gate: fails on any HIGH."""
    return findings.groupBy(*keys).agg(F.bool_or(F.col("severity") == "HIGH").alias("cli_fails"))


def scan_totals(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    return findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("findings_count"), F.count_if(F.col("severity") == "HIGH").alias("high_count")
    )
