"""Byte-level BPE encoding and decoding with numpy matrices.

Texts are split by the tokenizer's pattern. The distinct new pieces of a slice are put into padded matrices by
length class; in each round every row merges its leftmost pair of least rank, found through an open-addressing
hash table of pairs, and finished rows are taken out. A merge changes two pairs of its row, so only those are
looked up again. Pieces above ``LONG`` bytes, for which a round per merge would be quadratic, follow the same
rule with a heap.

Defined results: null counts as empty, an empty text has no tokens; ids decode to exactly the text's bytes;
repeated rows are encoded one by one; other columns are left alone. An unknown id fails the decoding.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import row_slices, text_buffers

LONG = 256
NONE = np.int32(2 ** 31 - 1)
#: Pieces that a task remembers. Beyond it the memory starts afresh, which costs time and changes no result.
REMEMBERED = 300_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of their ids, which must run from 0 without a gap."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Merges:
    """Pair lookup and merging for one vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        rank = {t: i for i, t in enumerate(tokens)}
        self.single = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for i, t in enumerate(tokens):
            for cut in range(1, len(t)):
                left, right = rank.get(t[:cut]), rank.get(t[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        self.pairs = pairs
        self.shift = np.uint64(64 - max(4, (len(pairs) * 4).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        keys, values = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(keys)
        while len(keys):  # each free slot takes the last of its claimants; the others move on
            free = self.keys[slot] == -1
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            left = self.keys[slot] != keys
            self.values[slot[~left]] = values[~left]
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it does not merge. Negative ids are padding."""
        out = np.full(left.shape, NONE, np.int32)
        at = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        keys = left.ravel()[at].astype(np.int64) << 32 | right.ravel()[at].astype(np.int64)
        slot, flat = self._slot(keys), out.ravel()
        while len(at):
            seen = self.keys[slot]
            same = seen == keys
            flat[at[same]] = self.values[slot[same]]
            more = ~same & (seen != -1)
            at, keys, slot = at[more], keys[more], (slot[more] + 1) & (len(self.keys) - 1)
        return flat.reshape(left.shape)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        done: list[list[int]] = [[]] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if len(piece) > LONG:
                done[i] = self._long(piece)
            elif piece:
                classes.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for bits, members in classes.items():
            step = max(1, (1 << 20) >> bits)
            for a in range(0, len(members), step):
                self._matrix(pieces, members[a:a + step], max(2, 1 << bits), done)
        return done

    def _matrix(self, pieces, members, width, done) -> None:
        ids = np.full((len(members), width), -1, np.int32)
        lengths = np.array([len(pieces[i]) for i in members])
        ids[np.arange(width) < lengths[:, None]] = self.single[np.frombuffer(b"".join(pieces[i] for i in members), np.uint8)]
        names = np.array(members)
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        columns = np.arange(width)
        while len(ids):
            best = rank.argmin(axis=1)
            rows = np.arange(len(ids))
            least = rank[rows, best]
            over = least == NONE
            if over.any():
                for name, row in zip(names[over].tolist(), ids[over]):
                    done[name] = row[row >= 0].tolist()
                go = ~over
                ids, rank, names, best, least = ids[go], rank[go], names[go], best[go], least[go]
                rows = np.arange(len(ids))
                if not len(ids):
                    break
            # Close the gap behind each merged pair.
            moved = np.minimum(columns + (columns > best[:, None]), width - 1)
            ids = np.take_along_axis(ids, moved, axis=1)
            ids[:, -1] = -1
            ids[rows, best] = least
            rank = np.take_along_axis(rank, np.minimum(moved[:, :-1], width - 2), axis=1)
            rank[:, -1] = NONE
            after = np.minimum(best + 1, width - 1)
            fresh = self.ranks(ids[rows, best], np.where(best + 1 < width, ids[rows, after], -1))
            inside = best < width - 1
            rank[rows[inside], best[inside]] = fresh[inside]
            some = best > 0
            rank[rows[some], best[some] - 1] = self.ranks(ids[rows[some], best[some] - 1], ids[rows[some], best[some]])

    def _long(self, piece: bytes) -> list[int]:
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or self.pairs.get(ids[i] << 32 | ids[j]) != r:
                continue  # one of the two has merged meanwhile
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := self.pairs.get(r << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := self.pairs.get(ids[h] << 32 | r)) is not None:
                heapq.heappush(heap, (x, h))
        return [i for i in ids if i >= 0]


class Encoder:
    """What a task keeps: the merges and, for recent pieces, (ids, their decimal form, their number, their bytes)."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.merges, self.split, self.known = Merges(tokens), regex.compile(pattern).findall, {}

    def pieces(self, texts: list[str]) -> list[list[tuple]]:
        split = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        fresh = list(set().union(*split).difference(self.known))
        tokens = self.merges.tokens
        for piece, ids in zip(fresh, self.merges.encode([p.encode() for p in fresh])):
            self.known[piece] = (ids, ",".join(map(str, ids)), len(ids), b"".join([tokens[i] for i in ids]))
        get = self.known.__getitem__
        return [list(map(get, s)) for s in split]


def _slices(batch, column: int):
    _, offsets = text_buffers(batch.column(column))
    for a, b in row_slices(offsets, 2 << 20):
        yield a, b, [t or "" for t in batch.column(column).slice(a, b - a).to_pylist()]


def _encode(tokens, pattern: str):
    def run(batches):
        encoder = Encoder(tokens.value, pattern)
        for batch in batches:
            for a, b, texts in _slices(batch, batch.num_columns - 1):
                ids = [[i for piece in row for i in piece[0]] for row in encoder.pieces(texts)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)), pa.array(ids, pa.list_(pa.int32()))],
                    [*batch.schema.names[:-1], "ids"])

    return run


def _digests(tokens, pattern: str):
    def run(batches):
        encoder = Encoder(tokens.value, pattern)
        for batch in batches:
            for a, b, texts in _slices(batch, 1):
                counts, ids, decoded = [], [], []
                for row in encoder.pieces(texts):
                    counts.append(sum([p[2] for p in row]))
                    ids.append(hashlib.sha256(",".join([p[1] for p in row]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join([p[3] for p in row])).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _decode(tokens):
    def run(batches):
        table = tokens.value
        for batch in batches:
            texts = [b"".join([table[i] for i in ids or ()]) for ids in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(texts, pa.binary())],
                [*batch.schema.names[:-1], "decoded"])

    return run


def _named(df: DataFrame, drop: str, add: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != drop] + [add])


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) in place of the text, and of a column ``ids``. ``tokens`` is a vocabulary, so of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    own = [c for c in docs.columns if c not in (text_col, "ids")]
    rows = docs.select(*own, F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(_encode(shared, pattern), _named(rows, text_col, "ids array<int>"))


def decode(encoded: DataFrame, tokens: list[bytes], *, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary) in place of the ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokens)
    rows = encoded.select(*[c for c in encoded.columns if c not in (ids_col, "decoded")], ids_col)
    return rows.mapInArrow(_decode(shared), _named(rows, ids_col, "decoded binary"))


def digests(docs: DataFrame, tokens: list[bytes], pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass, without moving the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_digests(shared, pattern), _named(rows, "text", "n_tokens long, ids_sha256 string, decoded_sha256 string"))
