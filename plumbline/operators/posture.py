"""Posture per control area: one partial aggregation per scan, no cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import fixed_values as fv
from plumbline.functions.keys import literal_map
from plumbline.operators import ranking


def _chapters() -> dict[str, str]:
    chapter = {r[0]: r[1] for r in fv.REQUIREMENTS}
    return {c: chapter.get(ids[0], fv.DEFAULT_CHAPTER) for c, ids in fv.CATEGORY_REQUIREMENTS.items()}


def level(high: Column, total: Column) -> Column:
    return F.when(high > 0, "vulnerable").when(total > 0, "safer").otherwise("safe")


def area_posture(scans: DataFrame, findings: DataFrame, keys=("scan_id",)) -> DataFrame:
    """Four rows per scan, worst level first, ties in the fixed area order.

    The four areas are counters of one aggregation, so areas and scans without findings need no
    product of scans and areas.
    """
    counters = []
    for area in fv.CATEGORIES:
        here = F.col("asvs_category") == area
        counters += [
            F.count_if(here).alias(f"n_{area}"),
            F.count_if(here & (F.col("severity") == "HIGH")).alias(f"h_{area}"),
        ]
    counted = scans.select(*keys).join(findings.groupBy(*keys).agg(*counters), list(keys), "left")
    rows = []
    for n, area in enumerate(fv.CATEGORIES):
        total, high = F.coalesce(f"n_{area}", F.lit(0)), F.coalesce(f"h_{area}", F.lit(0))
        rows.append(
            F.struct(
                literal_map(fv.LEVEL_RANK)[level(high, total)].alias("level_rank"),
                F.lit(n).alias("area_ord"), F.lit(area).alias("category"),
                F.lit(fv.AREA_LABEL[area]).alias("label"), F.lit(_chapters()[area]).alias("chapter"),
                F.lit(len(fv.CATEGORY_REQUIREMENTS[area])).alias("controls"),
                level(high, total).alias("level"), total.alias("findings"), high.alias("high_count"),
            )
        )
    ordered = counted.select(*keys, F.posexplode(F.array_sort(F.array(*rows))).alias("position", "a"))
    return ordered.select(*keys, "position", "a.*").withColumn("summary", area_summary())


def area_summary() -> Column:
    """``nothing to do`` or ``<high> high · <n> finding(s)``."""
    noun = F.when(F.col("findings") == 1, "finding").otherwise("findings")
    text = F.format_string("%d high · %d %s", F.col("high_count"), F.col("findings"), noun)
    return F.when(F.col("level") == "safe", "nothing to do").otherwise(text)


def posture_chip(level_name: Column) -> tuple[Column, Column]:
    return literal_map(fv.LEVEL_LABEL)[level_name], literal_map(fv.LEVEL_CHIP)[level_name]


def overall_posture(areas: DataFrame, keys=("scan_id",)) -> DataFrame:
    """Worst area of each scan."""
    names = {rank: name for name, rank in fv.LEVEL_RANK.items()}
    label, chip = posture_chip(F.col("level"))
    return (
        areas.groupBy(*keys)
        .agg(F.min("level_rank").alias("worst"))
        .select(*keys, literal_map(names)[F.col("worst")].alias("level"))
        .withColumns({"level_label": label, "level_chip": chip})
    )


def area_findings(findings: DataFrame, keys=("scan_id",), bound: int = ranking.BOUND) -> DataFrame:
    """The findings of each area in their order, numbered from 1."""
    return ranking.row_number(
        findings.filter(F.col("asvs_category").isin(fv.CATEGORIES)), [*keys, "asvs_category"],
        [F.col("ord"), F.col("id"), F.col("detail")], "position", bound,
    )
