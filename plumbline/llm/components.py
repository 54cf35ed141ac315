"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.frames import stage

#: Salts that the edges of one vertex are dealt over.
SPREAD = 64


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v) with u > v: hang neighbours on the least vertex that each vertex knows.

    The least neighbour is taken per salt first, so a hub's edges are reduced before the shuffle, at most SPREAD
    rows a vertex are ordered together, and no key of the join back holds all edges of a hub. Both take the edges from
    one shuffle.
    """
    seen = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))) if large else edges
    seen = seen.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SPREAD))).repartition("u", "salt")
    least = seen.groupBy("u", "salt").agg(F.min("v").alias("m")).select(
        "u", "salt", F.least("u", F.min("m").over(Window.partitionBy("u"))).alias("m"))
    joined = seen.join(least, ["u", "salt"])
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every vertex hangs on one vertex only, and that one on none: the outcome of the steps."""
    ends = edges.select(F.col("u").alias("vertex"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("vertex").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where(
        "hangs > 1 OR (hangs = 1 AND holds = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of ``edges`` (a, b), as a written table; the component is its least vertex.

    Each round is a written table, too; the loop ends with stars, so edges that are stars already take no round.
    Labels are stars: given back as edges with further ones, only what these join takes rounds.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _are_stars(now):
        now = stage(_star(_star(now, large=True), large=False))
    own = now.select(F.col("v").alias("u"), "v").distinct()
    return stage(now.union(own).select(F.col("u").alias("v"), F.col("v").alias("component")))
