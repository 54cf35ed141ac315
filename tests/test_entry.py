"""The registered queries agree with their oracles at the smallest scale."""

import importlib.util
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
# A cross-section that keeps the suite short; the driver runs every query.
CHECKED = [
    "scan_projects", "admitted_files", "baseline_history", "findings_carried", "persisted_posture_history", "area_posture", "report_bodies",
    "superseded_jobs", "job_state", "rate_limit", "subscription_state", "cache_upsert", "setup_upserts",
    "scan_in_rule_order", "progress_feed", "findings_from_enricher",
]


def normal(frame: pd.DataFrame) -> list[tuple]:
    def cell(value):
        if value is None or value is pd.NaT or value is pd.NA or value != value:
            return None
        if hasattr(value, "isoformat"):
            return pd.Timestamp(value).isoformat()
        return str(int(value)) if isinstance(value, float) and value == int(value) else str(value)

    ordered = frame[sorted(frame.columns)]
    return sorted((tuple(map(cell, row)) for row in ordered.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_oracle(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="a checkout without these queries")
@pytest.mark.parametrize("name", ["public_tokenizers", "plumbline.llm", "corpus_pipeline"])
def test_missing_modules_leave_the_other_queries(name):
    """A missing dependency of the training-data operators takes only their queries away."""
    code = f"import sys; sys.modules[{name!r}] = None; import __spark_entry__ as e; print(len(e.queries()), sorted(e.queries())[:1])"
    folder = os.path.dirname(os.path.abspath(entry.__file__))
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True)
    assert done.stdout.split()[0] == str(sum(not q.startswith("op") and q != "pipeline" for q in entry.queries())) and name in done.stderr
