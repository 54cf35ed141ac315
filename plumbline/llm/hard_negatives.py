"""Hard negatives from rotated one-bit codes with deterministic intervals.

Components become the integers ``floor(scale * x)``; a score is the integer inner product with the anchor. Each
vector is rotated and kept as its sign bits c (a unit vector of +-1/sqrt(d)), with its alignment ``t = <x, c>`` and
the length of the rest ``r = x - t c``. An anchor is rotated by the same rotation and rounded to a few bit planes;
popcounts of code and plane give ``v``, the estimate of ``<c, a>``, up to the length e of the rounding error. So

    <x, a> = t <c, a> + <r, a>  lies in  t v +- (|t| e + |r| sqrt(|a|^2 - max(0, |v| - e)^2))

by Cauchy-Schwarz, never outside. Pairs whose interval cannot matter go; all that survive are scored in integers.
First an anchor's positives (the leading rows of its label): the ``k``-th greatest lower end is a floor for the
upper ends. Then, for each positive, the leading rows of other labels with scores between ``low`` and ``high`` per
cent of the positive's: intervals that miss all these ranges go.

Anchors are a stated query set: they and all rows are dealt to blocks by hash (about ``block`` numbers each), every
block of anchors meets every block of rows once in a task of bounded memory, and the leading few of each block are
merged. No pair of rows leaves a task otherwise.

Defined results: rows with a null id, label or vector, an empty vector or a null, NaN or infinite component take
no part; nor do vectors longer than 2^30 after scaling, as their scores need not fit a 64-bit number. Equal
rows count once; an id with several rows takes part with each, and never meets itself. Ties go to the smaller id.
Vectors are compared with vectors of the same length only. A zero vector scores 0. Other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.frames import parallelism, stage

PLANES = 4
CODE = "dim int, id long, row long, label long, asked boolean, vector binary, width int, code binary, along double, rest double, length double"
TILE = 64
LONGEST = float(1 << 60)


@functools.lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix; any rotation gives right intervals, and each process makes its own copy."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of integer vectors, their alignment, the length of the rest, and the whole length."""
    turned = vectors.astype(np.float64) @ rotation(vectors.shape[1])
    bits = turned > 0
    along = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    return words_of(bits), along, np.sqrt(np.maximum(length**2 - along**2, 0) + 1e-9 * length**2), length


def intervals(anchors: np.ndarray, dim: int, code: np.ndarray, along: np.ndarray, rest: np.ndarray, length: np.ndarray):
    """Lower and upper ends of all scores of some anchors (integer vectors) with coded rows."""
    turned = anchors.astype(np.float64) @ rotation(dim)
    least = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - least) / ((1 << PLANES) - 1), 1e-300)
    level = np.rint((turned - least) / step).astype(np.int64)
    rounded = least + step * level
    error = np.sqrt(((turned - rounded) ** 2).sum(axis=1, keepdims=True))
    whole = np.sqrt((turned**2).sum(axis=1, keepdims=True))
    counted = np.zeros((len(anchors), len(code)))
    for plane in range(PLANES):
        bits = words_of((level >> plane & 1).astype(bool))
        for w in range(bits.shape[1]):
            counted += (1 << plane) * np.bitwise_count(bits[:, w, None] & code[None, :, w]).astype(np.float64)
    ones = np.zeros(len(code))
    for w in range(code.shape[1]):
        ones += np.bitwise_count(code[:, w])
    # <code, rounded> with components +-1/sqrt(d): twice the sum over its ones, less the whole sum.
    estimate = (2 * (least * ones + step * counted) - rounded.sum(axis=1, keepdims=True)) / np.sqrt(dim)
    inner = np.maximum(np.abs(estimate) - error, 0)
    slack = np.abs(along) * error + rest * np.sqrt(np.maximum(whole**2 - inner**2, 0)) + 1e-9 * whole * length + 1e-6
    return along * estimate - slack, along * estimate + slack


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point only where every partial sum is below 2^53."""
    longest = [np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) for x in (anchors, rows)]
    if longest[0] * longest[1] < 1 << 52:
        return np.rint(anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return anchors.astype(np.int64) @ rows.astype(np.int64).T


def _unpack(table: pa.Table) -> dict:
    """Columns of coded rows, in the order of (id, row)."""
    got = {c: table[c].to_numpy() for c in ("id", "row", "label", "along", "rest", "length")}
    order = np.lexsort((got["row"], got["id"]))
    dim = table["dim"][0].as_py()
    vectors, widths, codes = table["vector"].to_pylist(), table["width"].to_pylist(), table["code"].to_pylist()
    got = {c: x[order] for c, x in got.items()}
    got["vector"] = np.stack([np.frombuffer(vectors[i], f"i{widths[i]}").astype(np.int64) for i in order])
    got["code"] = np.frombuffer(b"".join(codes[i] for i in order), np.uint64).reshape(len(order), -1)
    return got | {"dim": dim, "order": order}


def _code_rows(batches):
    """Integer vectors with their codes, in the narrowest integers that hold them."""
    for batch in batches:
        lists = batch.column(3)
        size = lists.value_lengths().to_numpy()
        offsets = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()
        for dim in np.unique(size):
            rows = np.flatnonzero(size == dim)
            for a in range(0, len(rows), 4096):
                some = rows[a:a + 4096]
                vectors = flat[offsets[some][:, None] + np.arange(dim)].astype(np.int64)
                code, along, rest, length = encode(vectors)
                most = np.abs(vectors).max(axis=1)
                width = np.select([most < 1 << 15, most < 1 << 31], [2, 4], 8)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(some), dim, np.int32)), *[batch.column(c).take(pa.array(some)) for c in (0, 1, 2, 4)],
                    pa.array([v.astype(f"i{w}").tobytes() for v, w in zip(vectors, width)], pa.binary()), pa.array(width.astype(np.int32)),
                    pa.array([c.tobytes() for c in code], pa.binary()), pa.array(along), pa.array(rest), pa.array(length),
                ], [c.split()[0] for c in CODE.split(", ")])


def usable(rows: DataFrame, anchors: Column, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """Distinct (id, row, label, vector of whole numbers, asked) that take part; ``row`` tells rows of one id apart."""
    given = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.transform(F.col(vector_col).cast("array<double>"), lambda v: v * scale).alias("x"), anchors.alias("asked"))
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)  # null, NaN or infinite where a component is
    return given.where("id IS NOT NULL AND label IS NOT NULL AND size(x) > 0").where(square <= LONGEST).groupBy(
        "id", "label", F.transform("x", lambda v: F.floor(v)).alias("vector")).agg(F.max("asked").alias("asked")).select(
        "id", F.xxhash64("label", "vector").alias("row"), "label", "vector", F.coalesce("asked", F.lit(False)).alias("asked"))


def _leading(keep: np.ndarray, exact: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` greatest kept scores of each row, ties to the smaller column."""
    r, c = np.nonzero(keep)
    order = np.lexsort((c, -exact[r, c], r))
    r, c = r[order], c[order]
    lead = np.arange(len(r)) - np.searchsorted(r, np.arange(len(keep)))[r] < k
    return r[lead], c[lead]


def _tiles(a: dict, x: dict):
    """A few anchors at a time: their places, and the ends of their intervals with all rows of the block."""
    for at in range(0, len(a["id"]), TILE):
        s = slice(at, at + TILE)
        yield s, *intervals(a["vector"][s], a["dim"], x["code"], x["along"], x["rest"], x["length"])


def _result(names: str, parts: list[tuple]) -> pa.Table:
    columns = [c.split()[0] for c in names.split(", ")]
    whole = [np.concatenate(v) for v in zip(*parts)] if parts else [np.zeros(0)] * len(columns)
    return pa.table({c: pa.array(v.astype(np.int64)) for c, v in zip(columns, whole)})


POSITIVE = "anchor_id long, anchor_row long, id long, row long, score long"
NEGATIVE = "anchor_id long, anchor_row long, place long, id long, row long, score long"


def _positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if len(left) and len(right):
            a, x = _unpack(left), _unpack(right)
            for s, low, high in _tiles(a, x):
                mask = (a["label"][s][:, None] == x["label"]) & (a["id"][s][:, None] != x["id"])
                if len(x["id"]) > k:
                    mask &= high >= np.partition(np.where(mask, low, -np.inf), -k, axis=1)[:, -k, None]
                some = np.flatnonzero(mask.any(axis=0))
                exact = scores(a["vector"][s], x["vector"][some])
                r, c = _leading(mask[:, some], exact, k)
                parts.append((a["id"][s][r], a["row"][s][r], x["id"][some][c], x["row"][some][c], exact[r, c]))
        return _result(POSITIVE, parts)

    return run


def _negatives(k: int, low_share: int, high_share: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if len(left) and len(right):
            a, x = _unpack(left), _unpack(right)
            # For each anchor and positive the least and the greatest score of a negative; no score where there is none.
            told = [left["positives"][int(i)].as_py() for i in a["order"]]
            most = max(map(len, told))
            least_of, most_of = np.ones((len(told), most), np.int64), np.zeros((len(told), most), np.int64)
            for i, of in enumerate(told):
                for j, positive in enumerate(of):
                    least_of[i, j], most_of[i, j] = -(-low_share * positive // 100), high_share * positive // 100
            for s, low, high in _tiles(a, x):
                near = np.zeros(low.shape, bool)
                for j in range(most):
                    near |= (high >= least_of[s, j, None]) & (low <= most_of[s, j, None])
                near &= (a["label"][s][:, None] != x["label"]) & (a["id"][s][:, None] != x["id"])
                some = np.flatnonzero(near.any(axis=0))
                exact = scores(a["vector"][s], x["vector"][some])
                for j in range(most):
                    fits = near[:, some] & (exact >= least_of[s, j, None]) & (exact <= most_of[s, j, None])
                    r, c = _leading(fits, exact, k)
                    parts.append((a["id"][s][r], a["row"][s][r], np.full(len(r), j), x["id"][some][c], x["row"][some][c], exact[r, c]))
        return _result(NEGATIVE, parts)

    return run


def hard_negatives(rows: DataFrame, anchors: Column, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                   scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   block: int = 1 << 19) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on ``rows``; ``block`` the numbers (rows times dimensions) in a block.
    """
    parts = 2 * parallelism(rows.sparkSession)
    whole = usable(rows, anchors, id_col, label_col, vector_col, scale)
    coded = stage(whole.select("id", "row", "label", "vector", "asked").mapInArrow(_code_rows, CODE))
    asked = coded.where("asked").toDF(*coded.columns)
    size = coded.agg(F.sum("dim").alias("all"), F.sum(F.when(F.col("asked"), F.col("dim"))).alias("asked")).first()
    across, down = (max(1, -(-int(n or 0) // block)) for n in (size["all"], size["asked"]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id", "row"), F.lit(n)).cast("int")
    keys = ["dim", "down", "across"]
    # A number of partitions of our own keeps small blocks, whose work is great, from being packed into one task.
    table = coded.withColumns({"down": every(down), "across": own(across)}).repartition(parts, *keys).groupBy(*keys)

    def against(queries: DataFrame):
        return queries.withColumns({"across": every(across), "down": own(down)}).repartition(parts, *keys).groupBy(*keys).cogroup(table)

    anchor = ["anchor_id", "anchor_row"]
    best = Window.partitionBy(*anchor).orderBy(F.desc("score"), "id", "row")
    found = against(asked).applyInArrow(_positives(positives), POSITIVE)
    first = stage(found.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < positives))
    listed = first.groupBy(*anchor).agg(F.sort_array(F.collect_list(F.struct("place", "score")))["score"].alias("positives"))
    ready = asked.withColumnsRenamed({"id": "anchor_id", "row": "anchor_row"}).join(listed, anchor).withColumnsRenamed(
        {"anchor_id": "id", "anchor_row": "row"})
    mined = against(ready).applyInArrow(_negatives(negatives, low, high), NEGATIVE)
    best = Window.partitionBy(*anchor, "place").orderBy(F.desc("score"), "id", "row")
    ranked = mined.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives).select(
        *anchor, "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return first.select(*anchor, F.col("place").cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(
        ranked, [*anchor, "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
