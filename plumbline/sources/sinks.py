"""Writers: scans with their findings, text and JSON reports, check results.

A commit is a set of tables under one batch number. Readers see finished commits only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def clustered(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of equal values side by side, in tasks of the advisory size.

    AQE joins small groups and splits large ones, so a folder gets as many files as its bytes ask for and no task
    takes a hot value whole.
    """
    return rows.hint("rebalance", *columns)


def commit(folder: str, batch: str | int, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None) -> None:
    """Write some tables as one commit: all of them are visible with the marker that is written last, or none.

    Each batch owns a folder of each table and overwrites it, so a batch that is repeated appears once, and what a
    killed write has left is neither read nor added to.
    """
    for name, rows in tables.items():
        by = (partition_by or {}).get(name, [])
        writer = (clustered(rows, *by) if by else rows).write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{folder}/{name}/commit={batch}")
    _mark(next(iter(tables.values())).sparkSession, folder, batch)


def _mark(spark: SparkSession, folder: str, batch: str | int) -> None:
    spark.range(1).select(F.lit(str(batch)).alias("done")).write.mode("overwrite").parquet(f"{folder}/commits/commit={batch}")


def committed(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The rows of a table that belong to finished commits, with the column ``commit``."""
    as_text = lambda df: df.withColumn("commit", F.col("commit").cast("string"))
    done = as_text(spark.read.parquet(f"{folder}/commits")).select("commit").distinct()
    return as_text(spark.read.parquet(f"{folder}/{table}")).join(done, "commit", "left_semi")


def write_scans(scans: DataFrame, findings: DataFrame, folder: str, batch: str | int) -> None:
    """One row per scan and one per finding, both by scan date, as one commit.

    Findings stay in a child table, so that reading scan rows never touches them.
    """
    dated = scans.withColumn("scan_date", F.to_date("created_at"))
    children = findings.join(dated.select("scan_id", "scan_date"), "scan_id")
    commit(folder, batch, {"scans": dated, "scan_findings": children}, {"scans": ["scan_date"], "scan_findings": ["scan_date"]})


def write_documents(documents: DataFrame, folder: str, column: str = "json") -> None:
    """One JSON document per line."""
    documents.select(column).write.mode("append").text(folder)


def write_console(pages: DataFrame, folder: str, batch: str | int, buckets: int = 64) -> None:
    """Report pages as text; every page carries head, body and summary.

    Projects share ``buckets`` folders, however many there are; ``console_page`` reads one project back.
    """
    text = F.concat_ws("\n", "head", F.lit(""), "body", F.lit(""), "summary")
    bucket = _console_bucket(F.col("project_id"), buckets)
    commit(folder, batch, {"console": pages.select("project_id", "page", text.alias("value"), bucket.alias("bucket"))}, {"console": ["bucket"]})


def _console_bucket(project: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(project), F.lit(buckets)).cast("int")


def console_page(spark: SparkSession, folder: str, project: str, buckets: int = 64) -> DataFrame:
    """(commit, page, value) of one project; only its folder is opened."""
    rows = committed(spark, folder, "console").filter(F.col("bucket") == _console_bucket(F.lit(project), buckets))
    return rows.filter(F.col("project_id") == project).select("commit", "page", "value")


def write_results(results: DataFrame, folder: str, batch: str | int) -> None:
    commit(folder, batch, {"results": results})


def findings_json(findings: DataFrame) -> DataFrame:
    """Each row's findings struct as JSON text, for edges that store documents."""
    return findings.withColumn("json", F.to_json("finding"))


def findings_from_json(rows: DataFrame, schema: str, column: str = "json") -> DataFrame:
    """JSON array → rows' array; anything but an array reads as an empty one."""
    return rows.withColumn("findings", F.coalesce(F.from_json(column, f"array<{schema}>"), F.expr("array()")))
