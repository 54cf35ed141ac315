"""Registered queries: each has a Spark plan over the given tables and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``plan(tables) -> DataFrame`` under ``name``."""

    def register(plan: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = oracle
        return plan

    return register


def load_all() -> None:
    from plumbline.plans import billing, edges, events, files, findings, reports, streams, tenancy  # noqa: F401
