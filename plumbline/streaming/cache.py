"""The enrichment cache as a stream: each micro-batch writes the entries that it changes, and nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.operators.enrichment import CACHE_SCHEMA, cache_changes
from plumbline.session import stage
from plumbline.streaming.store import BatchStore, KeyedLog


def cache_log(store: BatchStore, initial: DataFrame | None = None, width: int = 8, buckets: int = 64) -> KeyedLog:
    return KeyedLog(store, "cache", CACHE_SCHEMA, ["cache_key"], base=initial, width=width, buckets=buckets)


def cache_step(
    store: BatchStore, model: str, now: str, initial: DataFrame | None = None, hits=None, width: int = 8, buckets: int = 64,
):
    """Answered findings overwrite their entries; ``hits(number)`` gives (cache_key, hits) to add up, if any."""
    log = cache_log(store, initial, width, buckets)

    def step(batch: DataFrame, number: int) -> None:
        fresh = stage(batch)
        used = None if hits is None else hits(number)
        keys = fresh.select("cache_key") if used is None else fresh.select("cache_key").unionByName(used.select("cache_key"))
        log.write(number, cache_changes(log.read(number, log.touched(keys)), fresh, model, now, used))

    return step
