"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

A lexicon is learned from labelled rows: all words whose document frequency under label 1 clearly exceeds that under
label 0. Texts with the same words count there as one, so copies push no other word out. One pass over the texts turns each into 16 numbers (lexicon densities, lexicon words near a second-person
word, capitals, punctuation, obfuscation). The trees are fitted on three quarters of the labelled rows, the
calibration on the rest. Only the fitting uses a sample, of about ``sample`` labelled rows by a hash of the id.

Defined results: null and empty texts count as texts without words and get a score like others; repeated rows
get equal scores; a document with several labels counts as toxic if one says so, null labels and labels without
an id do not count; without labels of both kinds every score is the share of label 1 (0 without labels). Other
columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import SMALL_SLICE_BYTES, key_bitmap, row_slices, stage, test_bits, text_buffers
from plumbline.llm.words import _BYTE, Words, byte_set, mix, powers

TOKEN = ~byte_set((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LETTER = byte_set((0x61, 0x7A), (0x80, 0xFF))
#: Look-alikes, read as letters in the second form of a word.
LOOKS = np.arange(256, dtype=np.uint8)
for _sign, _letter in zip(b"@401!3$57", b"aaoiiesst"):
    LOOKS[_sign] = _letter
SECOND_PERSON = (
    "you your yours yourself u ur tu te toi vous votre vos ton ta tes du dich dir dein deine ihr euch euer "
    "tú ti tus usted ustedes vosotros vuestro"
).split()
NEAR = 5
FEATURES = 16


def hashes(words: list[str]) -> np.ndarray:
    """The hashes that ``Words`` gives to these words."""
    raw = [w.encode() for w in words]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    return Words(data, np.array([0, len(data)]), TOKEN).hash


def _folded(tokens: Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the tokens with only letters and digits left, and the bounds of the words in what is left."""
    text = table[tokens.text]
    keep = ALNUM[text]
    left = text[keep]
    place = np.concatenate([[0], np.cumsum(keep)])
    first, last = place[tokens.first], place[tokens.last]
    power, inverse = powers(len(left) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[left] * power[:len(left)], dtype=np.uint64)])
    return mix((total[last] - total[first]) * inverse[first]), first, last


def _weights(h: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(h))
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], 0.0)


def _features(data, offsets, keys, values, strong, persons) -> np.ndarray:
    rows = len(offsets) - 1
    tokens = Words(data, offsets, TOKEN)
    row = tokens.row_of()
    bare, first, last = _folded(tokens, np.arange(256, dtype=np.uint8))
    looks, _, _ = _folded(tokens, LOOKS)
    plain = _weights(tokens.hash, keys, values)
    weight = np.maximum(np.maximum(_weights(bare, keys, values), _weights(looks, keys, values)), plain)
    hit = weight > 0
    size, letters = tokens.last - tokens.first, last - first
    text, base = tokens.text, offsets[0]
    symbols = np.concatenate([[0], np.cumsum(byte_set((0x21, 0x21), (0x23, 0x26), (0x2A, 0x2B), (0x3D, 0x3D), (0x40, 0x40), (0x5E, 0x5F), (0x7E, 0x7E))[text])])
    odd = (letters > 0) & (symbols[tokens.last] - symbols[tokens.first] > 0)
    person = _weights(bare, persons, np.ones(len(persons))) > 0
    spread = np.concatenate([[0], np.cumsum(person)])
    n, at = len(bare), np.arange(len(bare))
    low = np.maximum(at - NEAR, np.repeat(tokens.row[:-1], np.diff(tokens.row)))
    high = np.minimum(at + NEAR + 1, np.repeat(tokens.row[1:], np.diff(tokens.row)))
    close = hit & (spread[high] - spread[low] > 0) if n else hit
    raw = data[base:offsets[-1]]
    big = byte_set((0x41, 0x5A))[raw]
    bigs = np.concatenate([[0], np.cumsum(big)])
    shout = (letters >= 3) & (bigs[tokens.last] - bigs[tokens.first] == letters)
    same = np.zeros(len(text), bool)
    if len(text) > 2:
        same[2:] = (text[2:] == text[1:-1]) & (text[1:-1] == text[:-2]) & LETTER[text[2:]]

    def per_row(x):
        return np.bincount(row, weights=x, minlength=rows)

    edges = offsets - base

    def per_byte(x):
        total = np.concatenate([[0], np.cumsum(x)])
        return (total[edges[1:]] - total[edges[:-1]]).astype(float)

    words, chars = np.maximum(np.diff(tokens.row), 1), np.maximum(np.diff(edges), 1)
    peak = np.zeros(rows)
    np.maximum.at(peak, row[hit], weight[hit])
    hits = per_row(hit)
    out = [
        np.log1p(np.diff(tokens.row)), per_row(weight) / words, np.log1p(hits), per_row(weight >= strong) / words,
        np.log1p(per_row(weight >= strong)), per_row(hit & (plain == 0) & odd) / words, per_row(person) / words,
        per_row(close) / words, per_byte(big) / chars, per_row(shout) / words, per_byte(text == 0x21) / chars,
        per_byte(byte_set((0x22, 0x2F), (0x3A, 0x40), (0x5B, 0x5F), (0x7B, 0x7E))[text]) / chars, per_row(odd) / words,
        per_byte(same) / chars, peak, per_row(size) / words,
    ]
    return np.stack(out, axis=1)


def _vectors(lexicon, strong: float):
    def run(batches):
        table = lexicon.value
        keys = hashes([w for w, _ in table])
        order = np.argsort(keys)
        keys, values = keys[order], np.array([x for _, x in table])[order]
        persons = np.sort(hashes(SECOND_PERSON))
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in row_slices(offsets, SMALL_SLICE_BYTES):
                flat = _features(data, offsets[a:b + 1], keys, values, strong, persons)
                ends = np.arange(0, flat.size + 1, FEATURES, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))], ["id", "x"])

    return run


def _vocabularies(bitmap):
    """(id, distinct words) of the documents whose id passes the filter."""
    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            hashed = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            batch = batch.filter(pa.array(test_bits(bits, hashed)))
            data, offsets = text_buffers(batch.column(2))
            for a, b in row_slices(offsets, SMALL_SLICE_BYTES):
                tokens = Words(data, offsets[a:b + 1], TOKEN)
                bare, first, last = _folded(tokens, np.arange(256, dtype=np.uint8))
                left = tokens.text[ALNUM[tokens.text]].tobytes()
                row, lists = tokens.row, []
                for i in range(b - a):
                    _, at = np.unique(bare[row[i]:row[i + 1]], return_index=True)
                    at = at + row[i]
                    at = at[last[at] - first[at] >= 2]
                    lists.append([left[x:y].decode("utf-8", "ignore") for x, y in zip(first[at].tolist(), last[at].tolist())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(lists, pa.list_(pa.string()))], ["id", "words"])

    return run


def learn_lexicon(texts: DataFrame, labelled: DataFrame) -> list[tuple[str, float]]:
    """All (word, log odds) that pass, the surest first. ``texts`` is (id, text), ``labelled`` (id, label).

    Texts with one set of words count once, as toxic if one of their labels says so.
    """
    spark = texts.sparkSession
    bitmap = spark.sparkContext.broadcast(key_bitmap(labelled.select(F.xxhash64("id").alias("h")), "h"))
    words = texts.where("id IS NOT NULL").select("id", F.xxhash64("id").alias("h"), "text").mapInArrow(
        _vocabularies(bitmap), "id long, words array<string>")
    # Equal sets come as equal arrays; copies are folded ahead of the shuffle.
    rows = stage(
        words.join(labelled, "id").groupBy(F.md5(F.array_join("words", " ")).alias("key"))
        .agg(F.max("label").alias("label"), F.first("words").alias("words")))
    sums = rows.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).first()
    toxic, clean = float(sums["toxic"] or 0), float(sums["clean"] or 0)
    if not toxic or not clean:
        return []
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (toxic + 1)) - F.log(b / (clean + 1))
    best = (
        rows.select("label", F.explode("words").alias("word")).groupBy("word")
        .agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
        .where(F.col("a") >= max(3.0, 0.002 * toxic))
        .select("word", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"))
        .where("odds > 1 AND z > 3").orderBy(F.desc("z"), "word"))
    return [(r["word"], float(r["odds"])) for r in best.collect()]


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             label_id: str = "doc_id", label_col: str = "toxic", sample: int = 20_000, trees: int = 20,
             depth: int = 4) -> DataFrame:
    """One row per document: (id, score), the score between 0 and 1."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    every = labels.where(F.col(label_id).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(label_id).cast("long").alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    many = every.count()
    share = min(1.0, sample / many) if many else 1.0
    labelled = stage(every.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20))))
    lexicon = learn_lexicon(texts, labelled)
    strong = float(np.median([x for _, x in lexicon])) if lexicon else 1.0
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = stage(texts.mapInArrow(_vectors(shared, strong), "id long, x array<double>"))
    fitted = stage(
        rows.where("id IS NOT NULL").join(labelled, "id")
        .select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"),
                F.pmod(F.xxhash64("id", F.lit(2)), F.lit(4)).alias("part")).coalesce(6))
    counts = fitted.groupBy((F.col("part") == 0).alias("calibrate"), "label").count().collect()  # at most four rows
    if len(counts) < 4:  # too few labels to fit and to calibrate
        toxic, total = sum(r["count"] for r in counts if r["label"] > 0), sum(r["count"] for r in counts)
        prior = toxic / total if total else 0.0
        return rows.select("id", F.lit(prior).alias("score"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, cacheNodeIds=False).fit(fitted.where("part <> 0"))
    raw = lambda df: model.transform(df).withColumn("raw", vector_to_array("probability")[1])
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(
        raw(fitted.where("part = 0")).select("raw", "label"))
    scored = curve.transform(raw(rows.select("id", array_to_vector("x").alias("features"))))
    return scored.select("id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))).alias("score"))
