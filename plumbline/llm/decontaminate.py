"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words; a shorter item is one window. Winnowing keeps the least hash of the
``k``-word grams inside each window (``window - k + 1`` grams), so two equal windows always keep the same
fingerprint and every shared span of ``window`` words is found. Fingerprints of documents pass a Bloom filter
of fixed size over the benchmark's fingerprints, are joined with them, and each hit is extended: the whole
window around it must be equal, word for word. Nothing of the benchmark is broadcast but the filter.

Defined results: null and empty texts have no words and are never hit; repeated rows are handled one by one
and get equal results; items without words, null items and empty tables hit nothing; an item without an id
marks words but is not counted or listed; extra columns of either table are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.frames import key_bitmap, row_key, row_slices, stage, test_bits, text_buffers
from plumbline.llm.words import Words, byte_set, mix, sliding_min

WORD = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))  # after lower-casing


def _fingerprints(words: Words, window: int, k: int, size: int) -> np.ndarray:
    """The fingerprint of the window of ``size`` words from each word on."""
    if size == window:
        return sliding_min(words.grams(k), window - k + 1)
    return mix(words.grams(size) + np.uint64(size))


def _item_windows(window: int, k: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in row_slices(offsets):
                words = Words(data, offsets[a:b + 1], WORD)
                ids, count, row = batch.column(0).slice(a, b - a), np.diff(words.row), words.row_of()
                for size in sorted({window, *count[(count > 0) & (count < window)].tolist()}):
                    starts = words.whole(size)
                    if size < window:
                        starts &= (count == size)[row]
                    starts = np.flatnonzero(starts)
                    prints = _fingerprints(words, window, k, size)[starts]
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array(row[starts])), pa.array(np.full(len(starts), size, np.int32)),
                        pa.array(prints.view(np.int64)), pa.array(words.sequences(starts, size), pa.string()),
                    ], ["item_id", "size", "fingerprint", "window"])

    return run


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, k: int) -> DataFrame:
    """(item_id, size, fingerprint, window) for every window of every item."""
    kind = items.schema[id_col].dataType.simpleString()
    return items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _item_windows(window, k), f"item_id {kind}, size int, fingerprint long, window string")


def _candidates(window: int, k: int, sizes: list[int], bitmap):
    """A row with the number of words for each document, and one for each window that passes the filter."""
    names = ["key", "id", "n_words", "size", "start", "fingerprint", "window"]

    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for a, b in row_slices(offsets):
                words = Words(data, offsets[a:b + 1], WORD)
                keys, ids, row = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), words.row_of()
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    keys, ids, pa.array(np.diff(words.row)), pa.nulls(b - a, pa.int32()), none, none,
                    pa.nulls(b - a, pa.string()),
                ], names)
                for size in sizes:
                    prints = _fingerprints(words, window, k, size)
                    starts = np.flatnonzero(words.whole(size) & test_bits(bits, prints))
                    n = len(starts)
                    if n:
                        yield pa.RecordBatch.from_arrays([
                            keys.take(pa.array(row[starts])), pa.nulls(n, ids.type), pa.nulls(n, pa.int64()),
                            pa.array(np.full(n, size, np.int32)), pa.array(starts - words.row[row[starts]]),
                            pa.array(prints[starts].view(np.int64)), pa.array(words.sequences(starts, size), pa.string()),
                        ], names)

    return run


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = 10,
                  k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Per document (key, id, n_words, n_hit, items sorted as strings), and the hit spans (key, start, size) in words.

    ``key`` is ``row_key(id_col, text_col)``; equal rows share it.
    """
    spark = docs.sparkSession
    prints = stage(item_windows(items, item_id, item_text, window, k))
    sizes = sorted(r["size"] for r in prints.select("size").distinct().collect())  # at most ``window`` numbers
    bitmap = spark.sparkContext.broadcast(key_bitmap(prints, "fingerprint"))
    kind = docs.schema[id_col].dataType.simpleString()
    found = stage(docs.select(
        row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
    ).mapInArrow(
        _candidates(window, k, sizes, bitmap),
        f"key binary, id {kind}, n_words long, size int, start long, fingerprint long, window string",
    ))
    base = found.where("size IS NULL").select("key", "id", "n_words")
    candidates = found.where("size IS NOT NULL").select("key", "size", "start", "fingerprint", "window")
    windows = prints.select("fingerprint", "window").distinct()
    hits = candidates.join(windows, ["fingerprint", "window"])
    before = F.max(F.col("start") + F.col("size")).over(
        Window.partitionBy("key").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("size")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.col("start"))))
    covered = hits.withColumn("fresh", fresh).groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    item_of = prints.where("item_id IS NOT NULL").select("fingerprint", "window", "item_id").distinct()
    listed = (
        hits.select("key", "fingerprint", "window").distinct().join(item_of, ["fingerprint", "window"])
        .select("key", "item_id").distinct()
        .groupBy("key").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    )
    result = base.join(covered.join(listed, "key", "left"), "key", "left").select(
        "key", "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    return result, hits.select("key", "start", "size")
