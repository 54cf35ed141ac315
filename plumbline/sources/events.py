"""Event sources: JSON lines in batch or as a stream, always with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import fixed_values as fv

REPO_EVENTS = "seq bigint, event string, payload string, ts timestamp_ntz"
BILLING_EVENTS = (
    "id string, type string, customer_id string, subscription string, created timestamp_ntz, arrival_seq bigint"
)
_ROUTED = ["installation", "installation_repositories", "push", "pull_request"]


def _reader(spark: SparkSession, stream: bool):
    return spark.readStream if stream else spark.read


def read_repo_events(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Repository events of the four handled kinds; everything else is only acknowledged."""
    return _reader(spark, stream).schema(REPO_EVENTS).json(folder).filter(F.col("event").isin(_ROUTED))


def read_billing_events(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Billing events as delivered. The ledger needs all types; state uses the handled ones."""
    return _reader(spark, stream).schema(BILLING_EVENTS).json(folder)


def handled_billing_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("type").isin(fv.BILLING_EVENT_TYPES))


def read_submissions(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """One submitted body per line, with the file it came from."""
    lines = _reader(spark, stream).text(folder)
    return lines.select(F.col("_metadata.file_name").alias("source"), "value")
