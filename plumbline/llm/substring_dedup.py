"""Removal of repeated byte strings by distributed difference-cover sampling.

A string of ``length`` bytes is removed where the same string starts earlier in the corpus (smaller id, or the
same document, earlier start). Comparing all suffixes to that depth goes in four steps; documents are dealt to
groups by their key, and one exchange of the texts serves all steps.

1. Sampled tuples: positions whose residue modulo 57 lies in a difference cover of 8 residues are sampled. Two
   equal strings, wherever they start, then have a sampled position at a common distance below 57 from both
   starts, so the 44-byte tuples there are equal. Tuples are named by fingerprints, which are sorted per hash
   range; a name that occurs once in the corpus ends there. Each group sends a name once, so a hot name costs
   one entry per group.
2. Remaining suffixes: only starts with a repeated name ahead can have a partner. They are cut into stretches
   whose strings share their least 16-byte gram, so equal strings meet in one range. Equal stretches of a group
   are sent once.
3. In each range all strings are sorted (by a fingerprint of the whole prefix, then by place), adjacent equal
   prefixes are compared byte for byte, and all but the first are marked.
4. The marks go back to the groups, and each document drops the covered bytes.

The depth is bounded, so one level of names decides and the recursion of the full suffix array is not needed.

Defined results: null counts as empty; texts shorter than ``length`` lose nothing; rows with the same id and
text are one document and get equal results; documents with the same id are ordered by their key, those without
an id come first; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import parallelism, row_key, row_slices, text_buffers
from plumbline.llm.words import _BYTE, among, distinct, mix, powers, repeats

PERIOD = 57
#: A perfect difference set: each residue is the difference of two of these.
COVER = np.array([0, 1, 3, 13, 32, 36, 43, 52])
GRAM = 16


def prefix_sums(text: np.ndarray, salt: int = 0) -> np.ndarray:
    values = _BYTE if not salt else mix(_BYTE + np.uint64(salt))
    total = np.empty(len(text) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values[text] * powers(len(text) + 1)[0][:len(text)], out=total[1:])
    return total


def prints(sums: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The fingerprint of ``length`` bytes from each position."""
    return mix((sums[at + length] - sums[at]) * powers(len(sums))[1][at])


class Group:
    """The distinct documents of a group in corpus order."""

    def __init__(self, table: pa.Table):
        keys, ids = table.column("key").to_pylist(), table.column("id").to_pylist()
        rows: dict[bytes, int] = {}
        self.repeats: dict[bytes, int] = {}
        for i, key in enumerate(keys):
            rows.setdefault(key, i)
            self.repeats[key] = self.repeats.get(key, 0) + 1
        order = sorted(rows.values(), key=lambda i: (ids[i] is not None, ids[i] or 0, keys[i]))
        self.keys, self.ids = [keys[i] for i in order], [ids[i] for i in order]
        taken = table.column("text").take(pa.array(order, pa.int64()))
        data, offsets = text_buffers(taken)
        self.text, self.offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]

    def slices(self, least: int):
        """(first document, base, bytes, document bounds) of slices that hold a text of ``least`` bytes."""
        for a, b in row_slices(self.offsets):
            base, end = self.offsets[a], self.offsets[b]
            if end - base >= least:
                yield a, base, self.text[base:end], self.offsets[a:b + 1] - base

    def samples(self, length: int):
        """For each slice its parts, the sampled positions, the bounds of their documents, and their names."""
        tuple_size = length - PERIOD + 1
        for a, base, text, bounds in self.slices(length):
            turns = -(-np.diff(bounds) // PERIOD)
            turn = np.arange(turns.sum()) - np.repeat(np.cumsum(turns) - turns, turns)
            at = ((np.repeat(bounds[:-1], turns) + PERIOD * turn)[:, None] + COVER[None, :]).ravel()
            start, end = (np.repeat(np.repeat(x, turns), len(COVER)) for x in (bounds[:-1], bounds[1:]))
            fits = at + tuple_size <= end
            at = at[fits]
            yield a, base, text, bounds, start[fits], at, prints(prefix_sums(text), at, tuple_size)


def _place(name: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash range of a name and the 32 bits kept of it there."""
    return ((name >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64), (name & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _names(length: int, ranges: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        part, group = key[0].as_py(), Group(table)
        every = [names for *_, names in group.samples(length)]
        spot, low = _place(np.concatenate(every) if every else np.zeros(0, np.uint64), ranges)
        codes = distinct(spot << 32 | low.astype(np.int64))
        edges = np.searchsorted(codes, np.arange(ranges + 1) << 32)
        rows = [(r, codes[a:b].astype(np.uint32).tobytes()) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
        return pa.table({
            "range": pa.array([r for r, _ in rows], pa.int32()), "part": pa.array([part] * len(rows), pa.int32()),
            "names": pa.array([n for _, n in rows], pa.binary())})

    return run


def _repeated(key: tuple, table: pa.Table) -> pa.Table:
    """For each group its names that another group has too."""
    parts = table.column("part").to_pylist()
    lists = [np.frombuffer(n.as_buffer(), np.uint32) for n in table.column("names")]
    twice = repeats(np.concatenate(lists))
    found = [n[among(n, twice)] for n in lists]
    return pa.table({
        "part": pa.array(parts, pa.int32()), "range": pa.array([key[0].as_py()] * len(parts), pa.int32()),
        "payload": pa.array([f.tobytes() for f in found], pa.binary()), "marks": pa.nulls(len(parts), pa.binary())})


def _known(table: pa.Table) -> np.ndarray:
    """The repeated names of a group as sorted (range, name) codes."""
    rows = table.filter(pc.is_null(table.column("marks")))
    codes = [np.int64(r) << 32 | np.frombuffer(n.as_buffer(), np.uint32).astype(np.int64)
             for r, n in zip(rows.column("range").to_pylist(), rows.column("payload"))]
    return np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


def _stretches(group: Group, known: np.ndarray, length: int, ranges: int):
    """(document, start, count, least gram) of the stretches of starts that may have a partner."""
    sampled = list(group.samples(length))
    local = repeats(np.concatenate([names for *_, names in sampled] or [np.zeros(0, np.uint64)]))
    out = []
    width = length - GRAM + 1
    for a, base, text, bounds, start, at, names in sampled:
        spot, low = _place(names, ranges)
        again = among(names, local) | among(spot << 32 | low.astype(np.int64), known)
        if not again.any():
            continue
        at, start = at[again], start[again]
        steps = np.bincount(np.maximum(start, at - PERIOD + 1), minlength=len(text) + 1) - np.bincount(at + 1, minlength=len(text) + 1)
        starts = np.flatnonzero(np.cumsum(steps)[:-1] > 0)
        starts = starts[starts + length <= bounds[np.searchsorted(bounds, starts, side="right")]]
        if not len(starts):
            continue
        grams = prints(prefix_sums(text), np.arange(len(text) - GRAM + 1), GRAM)
        reach = 1
        while reach * 2 <= width:
            grams = np.minimum(grams[:-reach], grams[reach:])
            reach *= 2
        rest = width - reach
        least = np.minimum(grams[starts], grams[starts + rest])
        first = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (least[1:] != least[:-1])]))
        counts = np.diff(np.append(first, len(starts)))
        document = np.searchsorted(group.offsets, base + starts[first], side="right") - 1
        out.append((document, base + starts[first], counts, least[first]))
    if not out:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
    return [np.concatenate(x) for x in zip(*out)]


def _locally(group: Group, known: np.ndarray, length: int, ranges: int):
    """The stretches, and for each whether an equal one stands earlier in the group."""
    document, start, count, least = _stretches(group, known, length, ranges)
    seen, again = set(), np.zeros(len(start), bool)
    whole = group.text.tobytes()
    for i, (a, b) in enumerate(zip(start.tolist(), (start + count + length - 1).tolist())):
        piece = whole[a:b]
        if piece in seen:
            again[i] = True
        else:
            seen.add(piece)
    return document, start, count, least, again


def _sent(length: int, ranges: int, targets: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        group = Group(left)
        part = key[0].as_py()
        document, start, count, least, again = _locally(group, _known(right), length, ranges)
        names = ["target", "part", "number", "count", "id", "tie", "start", "bytes"]
        columns: dict[str, list] = {n: [] for n in names}
        number = np.flatnonzero(~again)
        target = (mix(least[number]) % np.uint64(targets)).astype(np.int64)
        by = np.argsort(target, kind="stable")
        number, target = number[by], target[by]
        ids = np.array([-2 ** 63 if i is None else i for i in group.ids], np.int64)
        ties = np.frombuffer(b"".join(k[:8] for k in group.keys), ">u8").astype(np.uint64)
        for t, a, b in zip(*_runs(target)):
            n = number[a:b]
            columns["target"].append(t)
            columns["part"].append(part)
            columns["number"].append(n.astype(np.int32).tobytes())
            columns["count"].append(count[n].astype(np.int32).tobytes())
            columns["id"].append(ids[document[n]].tobytes())
            columns["tie"].append(ties[document[n]].tobytes())
            columns["start"].append((start[n] - group.offsets[document[n]]).astype(np.int64).tobytes())
            columns["bytes"].append(b"".join([group.text[x:y].tobytes() for x, y in zip(start[n], start[n] + count[n] + length - 1)]))
        return pa.table({n: pa.array(columns[n], pa.int32() if n in ("target", "part") else pa.binary()) for n in names})

    return run


def _runs(x: np.ndarray):
    """(value, first, end) of the runs of a sorted array."""
    if not len(x):
        return [], [], []
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[first].tolist(), first.tolist(), np.append(first[1:], len(x)).tolist()


def _later(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings at these places, given in corpus order, equals an earlier one."""
    # Eight bytes from every place at once; the last word of a prefix overlaps the one before.
    words = np.ndarray((max(0, len(text) - 7),), np.uint64, buffer=text, strides=(1,))
    steps = [*range(0, length - 7, 8), length - 8]
    salt = 0
    while True:
        names = prints(prefix_sums(text, salt), at, length)
        order = np.argsort(names, kind="stable")
        same = np.flatnonzero(names[order][1:] == names[order][:-1]) + 1
        a, b = at[order[same]], at[order[same - 1]]
        equal = all(np.array_equal(words[a + i], words[b + i]) for i in steps)
        if equal:
            later = np.zeros(len(at), bool)
            later[order[same]] = True
            return later
        salt += 1  # two different strings with one fingerprint: name all anew


def _compared(length: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        flat = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]
        numbers, counts = flat("number", np.int32), flat("count", np.int32)
        number, count = np.concatenate(numbers), np.concatenate(counts).astype(np.int64)
        owner = np.repeat(np.arange(len(numbers)), [len(n) for n in numbers])
        text = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in table.column("bytes")), np.uint8)
        size = count + length - 1
        place = np.concatenate([[0], np.cumsum(size)[:-1]])
        order = np.lexsort((np.concatenate(flat("start", np.int64)), np.concatenate(flat("tie", np.uint64)), np.concatenate(flat("id", np.int64))))
        many = count[order]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        later = _later(text, np.repeat(place[order], many) + inner, length)
        # Back to the order in which each group sent its stretches.
        edge = np.cumsum(many) - many
        begin = np.empty(len(order), np.int64)
        begin[order] = edge
        parts, rows = table.column("part").to_pylist(), {"part": [], "payload": [], "marks": []}
        for i, part in enumerate(parts):
            mine = np.arange(*np.searchsorted(owner, [i, i + 1]))
            n = count[mine]
            at = np.repeat(begin[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rows["part"].append(part)
            rows["payload"].append(number[mine].tobytes())
            rows["marks"].append(np.packbits(later[at]).tobytes())
        return pa.table({
            "part": pa.array(rows["part"], pa.int32()), "range": pa.nulls(len(parts), pa.int32()),
            "payload": pa.array(rows["payload"], pa.binary()), "marks": pa.array(rows["marks"], pa.binary())})

    return run


def _removed(length: int, ranges: int, texts: bool):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        group = Group(left)
        document, start, count, _, again = _locally(group, _known(right), length, ranges)
        edge = np.cumsum(count) - count
        later = np.repeat(again, count)
        told = right.filter(pc.is_valid(right.column("marks")))
        for payload, marks in zip(told.column("payload"), told.column("marks")):
            number = np.frombuffer(payload.as_buffer(), np.int32)
            n = count[number]
            at = np.repeat(edge[number], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            later[at] = np.unpackbits(np.frombuffer(marks.as_buffer(), np.uint8))[:len(at)].astype(bool)
        at = np.repeat(start, count) + np.arange(len(later)) - np.repeat(edge, count)
        at = at[later]
        steps = np.bincount(at, minlength=len(group.text) + 1) - np.bincount(at + length, minlength=len(group.text) + 1)
        gone = np.cumsum(steps)[:-1] > 0
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts
        rows: dict[str, list] = {n: [] for n in names}
        for i, k in enumerate(group.keys):
            a, b = group.offsets[i], group.offsets[i + 1]
            out = gone[a:b]
            kept = group.text[a:b][~out].tobytes()
            values = [group.ids[i], int(b - a), int(out.sum()), int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept]
            for _ in range(group.repeats[k]):
                for n, v in zip(names, values):
                    rows[n].append(v)
        kinds = {"id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
        return pa.table({n: pa.array(rows[n], kinds[n]) for n in names})

    return run


def drop_repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100,
                  texts: bool = True) -> DataFrame:
    """One row per document: (id, n_bytes, n_removed, n_spans, kept_sha256), and ``kept`` (binary) with ``texts``.

    ``length`` is at least 73. Ids must be whole numbers.
    """
    if length < PERIOD + GRAM:
        raise ValueError(f"length must be at least {PERIOD + GRAM}")
    parts = parallelism(docs.sparkSession)
    rows = docs.select(
        row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    names = rows.groupBy("part").applyInArrow(_names(length, parts), "range int, part int, names binary")
    repeated = names.groupBy("range").applyInArrow(_repeated, "part int, range int, payload binary, marks binary")
    sent = rows.groupBy("part").cogroup(repeated.groupBy("part")).applyInArrow(
        _sent(length, parts, 3 * parts),
        "target int, part int, number binary, count binary, id binary, tie binary, start binary, bytes binary")
    marks = sent.groupBy("target").applyInArrow(_compared(length), "part int, range int, payload binary, marks binary")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return rows.groupBy("part").cogroup(repeated.union(marks).groupBy("part")).applyInArrow(_removed(length, parts, texts), schema)
