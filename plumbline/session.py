"""Session settings and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "plumbline", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_FOLDERS: dict[str, str] = {}


def staging_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local run without one gets a scratch folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="plumbline-")
    return _LOCAL_FOLDERS[app]


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate result once and read it back.

    Used where several branches need the outcome of one expensive pass. The written table survives the
    loss of executors, cuts the lineage, and gives the planner true sizes.
    """
    path = f"{staging_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Input bytes for one task of ``spread_by_key``.
SPREAD_BYTES = 2 << 20


def spread_by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread narrow rows by key into tasks of a fixed input size, by the planner's own size estimate.

    For tables of short rows that grow on their way (texts, JSON bodies, sorted or hashed by the same key): the number
    of tasks follows the table, so what one of them sorts, hashes or spills does not. Rows are shuffled while they are
    narrow, and later steps by the same key need no further shuffle.
    """
    if df.isStreaming:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES)), *keys)


def spread_small_input(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread an input with too few splits to keep the cores busy ahead of CPU-heavy rules.

    Applies only below one default split per core, by the planner's own size estimate. A larger input
    already has enough splits and is never shuffled.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, *keys) if size < cores * (128 << 20) else df
