"""Near-duplicate detection with HyperMinHash registers.

A document's set is its distinct shingles of ``size`` words (a shorter text is one shingle). One 64-bit hash
per shingle picks one of 160 buckets; each bucket keeps its least hash as a register of 16 bits: the number of
leading zeros and the 10 bits behind the leading one. Four registers are a band. Texts with equal sets are one
class and only its smallest id goes on.

1. Members of a band are compared with the band's least and greatest id and four further members only (six stars),
   so a group of n copies gives 6 n pairs.
   A pair goes on if its register similarity, less the expected chance collisions, is not clearly below the
   threshold, and is then confirmed on the full sets. Confirmed links give components.
2. Bands whose members still lie in several components are contested. All pairs of their members across components are
   compared in place (sizes, an odd sketch of 1,024 bits that bounds the symmetric difference, 128 one-bit
   registers for large sets), and what can still be a link is confirmed in the same way. Nothing is capped.
3. Small sets have few bands to share, so sets of four to six shingles are also joined exactly: such a set is linked
   with each set that it becomes by losing one shingle. All other links have six shingles or more in common: these
   share no band only if all six lie in the bands of those that differ, with a chance of (2 / 40)^6 = 2e-8; for large
   sets at the very threshold the chance is about 3e-7.

Defined results: null and empty texts have an empty set, are linked with nothing and are kept; rows that share
an id are one vertex, so they share a component; rows without an id are not linked, have no component and are
kept; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.components import SPREAD, components
from plumbline.llm.frames import SMALL_SLICE_BYTES, key_bitmap, row_slices, stage, test_bits, text_buffers
from plumbline.llm.words import Words, byte_set, distinct, mix

WORD = ~byte_set((0x20, 0x20), (0x09, 0x0D))
REGISTERS = 160
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
#: Expected share of equal registers of unrelated sets, from the HyperMinHash paper: 0.1699 * 2^-r.
CHANCE = 0.1699 / 2 ** MANTISSA
SALTS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: Members of a band, besides its least and greatest id, that all others are compared with.
PIVOTS = 4
#: The filter over candidate ids has 16 bits an id or more, within these bounds (128 KB to 32 MB a task).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
ODD_BITS = 1024
ODD = [f"odd_{i}" for i in range(ODD_BITS // 64)]
BIT = ["bit_0", "bit_1"]


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    grams, counts = words.grams(size), np.diff(words.row)
    short = {n: words.grams(n) for n in set(counts[(counts > 0) & (counts < size)].tolist())}
    sets = []
    for start, n in zip(words.row[:-1].tolist(), counts.tolist()):
        if n >= size:
            sets.append(distinct(grams[start:start + n - size + 1]))
        elif n:
            sets.append(mix(short[n][start:start + 1] + np.uint64(n)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def registers(flat: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """HyperMinHash registers of each row; ``flat`` holds each row's hashes in rising order."""
    least = np.zeros(rows * REGISTERS, np.uint64)
    taken = np.zeros(rows * REGISTERS, bool)
    cell = row * REGISTERS + (mix(flat) % np.uint64(REGISTERS)).astype(np.int64)
    least[cell[::-1]] = flat[::-1]  # the last of several writes stays: the least hash
    taken[cell] = True
    _, exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))
    zeros = np.minimum(53 - exponent, 53).astype(np.uint64)
    mantissa = (least << np.minimum(zeros + np.uint64(1), np.uint64(54))) >> np.uint64(64 - MANTISSA)
    packed = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    return np.where(taken, packed, EMPTY).reshape(rows, REGISTERS)


def small_sizes(percent: int) -> range:
    """Set sizes at which losing one shingle keeps the similarity, but two sets that differ both ways are too far."""
    fits = [n for n in range(2, 101) if 100 * (n - 1) >= percent * n and 100 * (n - 1) < percent * (n + 1)]
    return range(fits[0], fits[-1] + 1) if fits else range(0)


def _sketch(size: int, small: range):
    names = ["id", "n", "same_a", "same_b", "regs", "less", *ODD, *BIT]

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in row_slices(offsets, SMALL_SLICE_BYTES):
                words = Words(data, offsets[a:b + 1], WORD)
                sets = shingle_sets(words, size)
                n = np.array([len(s) for s in sets])
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                row, rows = np.repeat(np.arange(b - a), n), b - a
                regs = registers(flat, row, rows)
                edge = np.concatenate([[0], np.cumsum(n)])
                sums, parts = [], []
                for salt in SALTS:
                    parts.append(mix(flat ^ np.uint64(salt)))
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(parts[-1], dtype=np.uint64)])
                    sums.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
                # For a small set the sums of the sets that lack one of its shingles.
                short = np.isin(n, small)
                less = (sums[0].view(np.uint64)[row] - parts[0]).view(np.int64)[short[row]]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(short, n, 0))]).astype(np.int32)), pa.array(less))
                place = (mix(flat + np.uint64(77)) % np.uint64(ODD_BITS)).astype(np.int64)
                odd = np.bincount(row * ODD_BITS + place, minlength=rows * ODD_BITS).reshape(rows, ODD_BITS) & 1
                odd = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
                bits = (mix(regs[:, :128].astype(np.uint64) + np.uint64(5)) & np.uint64(1)).astype(np.uint8)
                bits = np.packbits(bits, axis=1).view(np.int64)
                raw = regs.tobytes()
                width = REGISTERS * 2
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, rows), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]),
                    pa.array([raw[i * width:(i + 1) * width] for i in range(rows)], pa.binary()), lists,
                    *[pa.array(np.ascontiguousarray(x)) for x in (*odd.T, *bits.T)],
                ], names)

    return run


def _bands(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        words = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        real = words != np.uint64(0xFFFFFFFFFFFFFFFF)
        keys = mix(words ^ mix(np.arange(1, words.shape[1] + 1, dtype=np.uint64)))
        row, _ = np.nonzero(real)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[real].view(np.int64)), batch.column(0).take(pa.array(row))], ["band", "id"])


def estimate(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of register rows, and the number of buckets that either set fills."""
    used = np.maximum(((one != EMPTY) | (other != EMPTY)).sum(axis=1), 1)
    equal = ((one == other) & (one != EMPTY)).sum(axis=1) / used
    return np.clip((equal - CHANCE) / (1 - CHANCE), 0, 1), used


def _likely(threshold: float, sigmas: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            one, other = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            close, used = estimate(one, other)
            keep = close >= threshold - sigmas * np.sqrt(threshold * (1 - threshold) / used)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["a", "b"])

    return run


def _sets_of(size: int, bitmap):
    """The full sets of the rows (id, h, text) whose hash the filter may hold.

    Filter and sets are one function: a task that chains two holds two Python workers, and an executor keeps them.
    """
    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            hashed = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            batch = batch.filter(pa.array(test_bits(bits, hashed)))
            data, offsets = text_buffers(batch.column(2))
            for a, b in row_slices(offsets, SMALL_SLICE_BYTES):
                sets = shingle_sets(Words(data, offsets[a:b + 1], WORD), size)
                sums = [[int(mix(s ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                        for salt in SALTS]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ], ["id", "same_a", "same_b", "members"])

    return run


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(other.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                    percent: int = 75, sigmas: float = 5.0) -> DataFrame:
    """One row per document: (id, n, component). Ids must be whole numbers."""
    spark, small = docs.sparkSession, small_sizes(percent)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = stage(texts.mapInArrow(
        _sketch(size, small), "id long, n long, same_a long, same_b long, regs binary, less array<long>, " + ", ".join(f"{c} long" for c in (*ODD, *BIT))))
    filled = sketches.where("n > 0 AND id IS NOT NULL")
    # Copies of one set are dealt over salts: at most SPREAD rows a set are ordered together, and no join key holds them all.
    salted = filled.select("id", "same_a", "same_b", F.pmod(F.xxhash64("id"), F.lit(SPREAD)).alias("salt"))
    dealt = ["same_a", "same_b", "salt"]
    least = salted.groupBy(dealt).agg(F.min("id").alias("least")).select(
        *dealt, F.min("least").over(Window.partitionBy("same_a", "same_b")).alias("class"))
    member = stage(salted.join(least, dealt).select("id", "class", "same_a", "same_b"))
    chosen = member.where("id = class").select("id", "same_a", "same_b").distinct()
    one_each = ["id", "same_a", "same_b"]
    reps = stage(
        filled.join(chosen, one_each, "left_semi").dropDuplicates(one_each)
        .select("id", "n", "same_a", "same_b", "regs", "less", *ODD, *BIT))
    bands = reps.select("id", "regs").mapInArrow(_bands, "band long, id long")
    hubs = F.array(F.min("id"), F.max("id"), *[F.min_by("id", F.xxhash64("id", F.lit(n))) for n in range(PIVOTS)])
    groups = bands.groupBy("band").agg(F.count("*").alias("many"), F.array_distinct(hubs).alias("hubs")).where("many > 1")
    shared = stage(bands.join(groups, "band").select("band", "id", "hubs"))

    def confirm(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links, some more than once: first by registers, then on the full sets."""
        registers_of = reps.select("id", "regs")
        both = (
            pairs.join(registers_of.toDF("a", "regs_a"), "a").join(registers_of.toDF("b", "regs_b"), "b")
            .select("a", "b", "regs_a", "regs_b").mapInArrow(_likely(percent / 100, sigmas), "a long, b long"))
        likely = stage(both.distinct())
        ends = likely.select(F.explode(F.array("a", "b")).alias("id"))
        bits = min(max(1 << (32 * likely.count()).bit_length(), LEAST_BITS), MOST_BITS)
        bitmap = spark.sparkContext.broadcast(key_bitmap(ends.select(F.xxhash64("id").alias("h")), "h", bits))
        # The filter lets few other texts become sets (1 in 16 at most, until it has reached its bound); no pair joins these.
        sets = (
            texts.where("id IS NOT NULL").select("id", F.xxhash64("id").alias("h"), "text")
            .mapInArrow(_sets_of(size, bitmap), "id long, same_a long, same_b long, members binary")
            .join(chosen, one_each, "left_semi").dropDuplicates(one_each).select("id", "members"))
        sets = stage(sets)
        return (
            likely.join(sets.toDF("a", "members_a"), "a").join(sets.toDF("b", "members_b"), "b")
            .select("a", "b", "members_a", "members_b").mapInArrow(_confirmed(percent), "a long, b long"))

    stars = shared.select("id", F.explode("hubs").alias("hub")).where("id <> hub").select(
        F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    # Each set has one class, so a shingle's loss leads to one row at most, however many sets it leads there from.
    whole = reps.where(F.col("n").isin([n - 1 for n in small])).select("same_a", F.col("id").alias("other"))
    one_less = reps.where(F.size("less") > 0).select("id", F.explode("less").alias("same_a")).join(whole, "same_a").where("id <> other")
    stars = stage(stars.union(one_less.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))).distinct())
    # Rows that share an id are one vertex: its classes hang together.
    repeated = member.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a < z").drop("z")
    same_id = member.join(repeated, "id").select("a", F.col("class").alias("b")).where("a <> b")

    def with_links(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """The components after the links among staged pairs; without pairs they stay, and nothing is run."""
        if pairs.isEmpty():
            return labels
        return components(labels.select(F.col("v").alias("a"), F.col("component").alias("b")).union(confirm(pairs)))

    def by_component(labels: DataFrame) -> DataFrame:
        return shared.select("band", "id").join(labels.withColumnRenamed("v", "id"), "id", "left").select(
            "band", "id", F.coalesce("component", "id").alias("component"))

    # Most large groups hang together after the stars.
    labels = components(confirm(stars).union(same_id))
    labelled = by_component(labels)
    contested = labelled.groupBy("band").agg(
        F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    rows = stage(
        labelled.join(contested, "band")
        .join(reps.select("id", "n", *ODD, *BIT), "id"))
    x, y = rows.alias("x"), rows.alias("y")
    differ = lambda names: reduce(add, (F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in names))
    total = F.col("x.n") + F.col("y.n")
    # 128 one-bit registers at similarity s differ in 64 (1 - s) places; the margin is ``sigmas`` deviations.
    share = (1 - percent / 100) / 2
    most = 128 * share + sigmas * (128 * share * (1 - share)) ** 0.5
    possible = (
        (F.col("x.band") == F.col("y.band")) & (F.col("x.id") < F.col("y.id"))
        & (F.col("x.component") != F.col("y.component"))
        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
        & ((100 + percent) * differ(ODD) <= (100 - percent) * total)
        & ((F.least("x.n", "y.n") < 4 * REGISTERS) | (differ(BIT) <= most))
    )
    rest = x.join(y, possible).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(
        stars, ["a", "b"], "left_anti")
    labels = with_links(labels, stage(rest))

    joined = sketches.join(member.select("id", "class", "same_a", "same_b").distinct(), one_each, "left")
    return joined.join(labels.withColumnRenamed("v", "class"), "class", "left").select(
        "id", "n", F.coalesce("component", "class", "id").alias("component"))
