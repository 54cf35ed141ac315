"""Content-hash cache and merge of enrichments. Identical findings share one cached row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.keys import cache_key, requirement_confidence
from plumbline.operators.controls import primary_requirement
from plumbline.session import stage

# The part of an analyzed finding that is cached; the caller's own columns never are.
DELTA = ["req_id", "req_title", "likely", "explanation", "steps", "example"]
CACHE_SCHEMA = (
    "cache_key string, req_id string, req_title string, likely string, explanation string, steps array<string>, "
    "example string, model string, created_at timestamp_ntz, hit_count bigint"
)


def with_cache_key(findings: DataFrame) -> DataFrame:
    return findings.withColumn("cache_key", cache_key(F.col("id"), F.col("code_snippet"), F.col("detail")))


def cache_lookup(findings: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Overlay the cached delta; ``cached`` tells hits. A row of another model is a miss.

    The finding side is the outer side, so a key shared by a third of all rows can be split at run time.
    """
    usable = cache.filter(F.col("model") == model).select("cache_key", *DELTA, F.lit(True).alias("cached"))
    joined = with_cache_key(findings).join(usable, "cache_key", "left")
    return joined.withColumn("cached", F.coalesce("cached", F.lit(False)))


def uncached(findings: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Findings an enricher has to see."""
    usable = cache.filter(F.col("model") == model).select("cache_key")
    return with_cache_key(findings).join(usable, "cache_key", "left_anti")


def merge_responses(findings: DataFrame, responses: DataFrame, dims, keys=("scan_id",)) -> DataFrame:
    """Join responses by finding id: the last response of an id wins, absent ids get the fallback.

    ``responses(keys, id, ord, likely, explanation, steps, example)``; ids may repeat on both sides.
    """
    last = responses.groupBy(*keys, "id").agg(
        F.max_by(F.struct("likely", "explanation", "steps", "example"), "ord").alias("r")
    )
    joined = primary_requirement(findings, dims).join(last, [*keys, "id"], "left")
    answered = F.col("r").isNotNull()
    return joined.withColumns(
        {
            "likely": F.when(answered, F.col("r.likely")).otherwise(requirement_confidence(F.col("confidence"))),
            "explanation": F.when(answered, F.col("r.explanation")).otherwise(F.col("detail")),
            "steps": F.when(answered, F.col("r.steps")).otherwise(F.array("remediation")),
            "example": F.col("r.example"),
            "answered": answered,
        }
    ).drop("r", "req_text")


def enrich(
    findings: DataFrame, cache: DataFrame, model: str, dims, enricher: Callable | None = None, keys=("scan_id",)
) -> DataFrame:
    """Cached rows as they are, the rest through ``enricher`` or the deterministic fallback.

    ``enricher`` is a ``mapInPandas`` function from finding batches to rows
    ``(keys, id, ord, likely, explanation, steps, example)``; it only sees findings the cache lacks.
    """
    looked_up = cache_lookup(findings, cache, model)
    hits = looked_up.filter("cached").withColumn("answered", F.lit(False))
    misses = looked_up.filter("NOT cached").drop(*DELTA)
    if enricher is None:
        schema = "id string, ord bigint, likely string, explanation string, steps array<string>, example string"
        responses = findings.sparkSession.createDataFrame([], schema)
        for key in keys:
            responses = responses.withColumn(key, F.lit(None).cast(findings.schema[key].dataType))
    else:
        key_types = ", ".join(f"{k} {findings.schema[k].dataType.simpleString()}" for k in keys)
        answers = "id string, ord bigint, likely string, explanation string, steps array<string>, example string"
        # Staged, so that no finding is sent twice however often the result is used.
        responses = stage(misses.mapInPandas(enricher, f"{key_types}, {answers}"))
    return hits.unionByName(merge_responses(misses, responses, dims, keys))


def cache_hits(lookups: DataFrame, batch: str) -> DataFrame:
    """Hits per key: one for every batch that used it, however many findings shared it."""
    used = lookups.filter("cached").select(batch, "cache_key").distinct()
    return used.groupBy("cache_key").agg(F.count(F.lit(1)).alias("hits"))


def _next_entries(cache: DataFrame, fresh: DataFrame, model: str, now: str, hits: DataFrame | None) -> DataFrame:
    """All entries after fresh answers and hits, with the flag ``changed``."""
    if hits is None:
        hits = cache.select("cache_key", F.lit(0).cast("bigint").alias("hits")).limit(0)
    latest = fresh.groupBy("cache_key").agg(F.max_by(F.struct(*DELTA), F.struct("ord", "id")).alias("f"))
    joined = cache.join(latest, "cache_key", "full").join(hits, "cache_key", "left")
    written = F.col("f").isNotNull()
    pick = lambda name: F.when(written, F.col(f"f.{name}")).otherwise(F.col(name)).alias(name)
    return joined.select(
        "cache_key", *[pick(c) for c in DELTA],
        F.when(written, F.lit(model)).otherwise(F.col("model")).alias("model"),
        F.when(written, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("created_at")).alias("created_at"),
        (F.coalesce("hit_count", F.lit(0)) + F.coalesce("hits", F.lit(0))).alias("hit_count"),
        (written | (F.coalesce("hits", F.lit(0)) > 0)).alias("changed"),
    )


def cache_changes(cache: DataFrame, fresh: DataFrame, model: str, now: str, hits: DataFrame | None = None) -> DataFrame:
    """Only the entries that fresh answers or hits change: the rows that a store has to write."""
    return _next_entries(cache, fresh, model, now, hits).filter("changed").drop("changed")


def cache_upsert(cache: DataFrame, fresh: DataFrame, model: str, now: str, hits: DataFrame | None = None) -> DataFrame:
    """Next snapshot: fresh model answers overwrite delta, model and time and keep the hit count.

    ``fresh`` are answered findings only; fallbacks are never cached. ``cache_changes`` gives the changed rows alone.
    """
    return _next_entries(cache, fresh, model, now, hits).drop("changed")
