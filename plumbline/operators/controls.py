"""Control references and the deterministic enrichment built on them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline import fixed_values as fv
from plumbline.functions.keys import requirement_confidence

REQUIREMENT_COLUMNS = ["id", "chapter", "section", "title", "text"]


class Controls(NamedTuple):
    """``requirements``, ``mapping(category, ord, req_id)``, and whether both are the built-in nine rows."""

    requirements: DataFrame
    mapping: DataFrame
    built_in: bool = False

    def side(self, dim: DataFrame) -> DataFrame:
        """Only the built-in list has a known size; a loaded one is left to the planner's estimate."""
        return F.broadcast(dim) if self.built_in else dim


def control_dims(spark: SparkSession, path: str | None = None) -> Controls:
    """The control reference as two dimensions.

    The built-in reference has nine rows each. ``path`` reads a JSON document of the same shape instead.
    """
    if path is None:
        requirements = spark.createDataFrame(fv.REQUIREMENTS, REQUIREMENT_COLUMNS)
        rows = [(c, n, i) for c, ids in fv.CATEGORY_REQUIREMENTS.items() for n, i in enumerate(ids)]
        return Controls(requirements, spark.createDataFrame(rows, "category string, ord int, req_id string"), True)
    schema = (
        "version string, source string, note string, categoryMap map<string,array<string>>, "
        "requirements array<struct<id:string,chapter:string,section:string,title:string,text:string>>"
    )
    document = spark.read.schema(schema).json(path, multiLine=True)
    requirements = document.select(F.inline("requirements"))
    mapped = document.select(F.explode("categoryMap").alias("category", "ids"))
    return Controls(requirements, mapped.select("category", F.posexplode("ids").alias("ord", "req_id")))


def requirements_of_category(rows: DataFrame, dims: Controls, category: str = "asvs_category") -> DataFrame:
    """All requirements of the row's category in map order; ids without a requirement are dropped."""
    listed = dims.mapping.join(dims.requirements.withColumnRenamed("id", "req_id"), "req_id")
    return rows.join(dims.side(listed), rows[category] == listed["category"]).drop("category")


def primary_requirement(rows: DataFrame, dims: Controls, category: str = "asvs_category") -> DataFrame:
    """Adds ``req_id`` and ``req_title`` of the first listed requirement, ``unknown`` and the category otherwise."""
    first = (
        dims.mapping.join(dims.requirements.withColumnRenamed("id", "req_id"), "req_id")
        .groupBy("category")
        .agg(F.min_by(F.struct("req_id", "title", "text"), "ord").alias("req"))
    )
    joined = rows.join(dims.side(first), rows[category] == first["category"], "left").drop("category")
    return joined.withColumns(
        {
            "req_id": F.coalesce("req.req_id", F.lit(fv.UNKNOWN_REQUIREMENT)),
            "req_title": F.coalesce("req.title", F.col(category)),
            "req_text": F.coalesce("req.text", F.lit(fv.NO_REQUIREMENT_TEXT)),
        }
    ).drop("req")


def _analyzed(requirement: Column) -> dict[str, Column]:
    return {
        "asvs_requirement": requirement,
        "is_likely_real_issue": requirement_confidence(F.col("confidence")),
        "explanation": F.col("detail"),
        "remediation_steps": F.array("remediation"),
        "code_fix_example": F.lit(None).cast("string"),
    }


def default_enrichment(findings: DataFrame, dims: Controls) -> DataFrame:
    """Analysis without a model: requirement by category, confidence, detail and the one remediation."""
    found = primary_requirement(findings, dims)
    requirement = F.struct(F.col("req_id").alias("id"), F.col("req_title").alias("title"))
    return found.withColumns(_analyzed(requirement)).drop("req_id", "req_title", "req_text")


def submission_enrichment(findings: DataFrame) -> DataFrame:
    """Fallback for submitted findings: the requirement is always unknown."""
    requirement = F.struct(F.lit(fv.UNKNOWN_REQUIREMENT).alias("id"), F.col("asvs_category").alias("title"))
    return findings.withColumns(_analyzed(requirement))
