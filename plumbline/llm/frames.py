"""Small helpers that all operators share: tables, row keys, staged tables, bounded key filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import stage, staging_folder

__all__ = ["read_table", "row_key", "spare_name", "key_bitmap", "test_bits", "text_buffers", "row_slices", "SMALL_SLICE_BYTES", "stage", "staging_folder", "parallelism"]

BITMAP_BITS = 1 << 23
SLICE_BYTES = 2 << 20
#: For passes that hold many arrays over a slice: a Python worker keeps the most that it ever took.
SMALL_SLICE_BYTES = 256 << 10


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*columns: str) -> Column:
    """A 128-bit key of a row's contents. Equal rows share it, and they also share every result."""
    parts = [p for c in columns for p in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull().cast("string"))]
    return F.unhex(F.md5(F.concat_ws("|", *parts)))


def key_bitmap(df: DataFrame, column: str, bits: int = BITMAP_BITS) -> bytes:
    """A one-hash Bloom filter over a long column: always ``bits / 8`` bytes, whatever the number of keys.

    A full filter lets more keys through to the exact join behind it and changes no result.
    """
    place = F.pmod(F.col(column), F.lit(bits)) + 1
    parts = (
        df.select(place.alias("v")).where("v IS NOT NULL")
        .groupBy(F.bitmap_bucket_number("v").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bitmap"))
        .collect()  # at most bits / 32768 rows of 4 KB
    )
    filled = bytearray(bits // 8)
    for part in parts:
        at = (part["bucket"] - 1) * 4096
        filled[at:at + len(part["bitmap"])] = part["bitmap"]
    return bytes(filled)


def test_bits(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may be in the filter."""
    place = keys & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its row offsets, without a copy. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), rows)
        yield start, end
        start = end
