"""Source divergence audit: how far the term shares of each source lie from those of its peers.

Terms are counted per (lang, source). A language keeps the terms that occur in at least ``least_docs`` of its
documents; each group, and the language as a whole, gives each kept term the share
``1 + floor(10^9 (count + 2) / (N + 2 V))``. The divergence of two shares is ``floor((p - q)^2 / (p + q))``.

The sums over all kept terms are taken row by row after Gustavson: the terms of a language are dealt to slices of
a term-major index; in each slice every group walks through its own terms and scatters, along the postings of each,
into one dense accumulator with a place for each peer. Pairs of postings are never emitted. Terms that one or both
lack have counts of zero but shares above zero: the accumulator starts from "both lack it" for all terms of the
slice, adds the own terms against zero and the peers' terms against zero (from counts of equal shares), and each
posting replaces its three zero parts by the true value. A slice yields one partial sum for each pair of groups,
and the slices' sums are added up.

Defined results: null text, lang and source count as empty texts; repeated rows are documents of their own; a
group without terms has the shares of zero counts; a language that keeps no term has pairs of value 0 and no
terms; texts of any length are read whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.frames import row_slices, stage, text_buffers
from plumbline.llm.words import LOWER, byte_set

TERM = byte_set((65, 90), (97, 122), (128, 255))
UNIT = 1_000_000_000
SLICE_POSTINGS = 1 << 17
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
PARTS = pa.schema([("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Row number and lower-cased term of each match in some rows."""
    text = LOWER[data[offsets[0]:offsets[-1]]]
    inside = TERM[text]
    edge = np.zeros(len(text) + 1, bool)
    edge[offsets - offsets[0]] = True
    before, after = np.zeros(len(text), bool), np.zeros(len(text), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    last = np.flatnonzero(inside & (~after | edge[1:])) + 1
    ends = np.zeros(len(first) + 1, np.int64)
    np.cumsum(last - first, out=ends[1:])
    flat = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(text[inside].tobytes()))
    return np.searchsorted(offsets - offsets[0], first, side="right") - 1, flat.dictionary_encode()


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts the keys, where each run of equal keys starts in it, and the runs' keys."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    return order, start, keys[start]


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per (lang, source, term) of a few megabytes: occurrences and documents; a null term for each group."""
    for batch in batches:
        lang, source = batch.column(1).dictionary_encode(), batch.column(2).dictionary_encode()
        data, offsets = text_buffers(batch.column(0))
        many = len(source.dictionary)
        group = lang.indices.to_numpy().astype(np.int64) * many + source.indices.to_numpy()

        def rows(groups, terms, n, docs, lang=lang, source=source, many=many):
            return pa.RecordBatch.from_arrays([
                lang.dictionary.take(pa.array(groups // many)), source.dictionary.take(pa.array(groups % many)), terms,
                pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=COUNTS)

        seen = np.unique(group)
        yield rows(seen, pa.nulls(len(seen), pa.string()), np.zeros(len(seen)), np.zeros(len(seen)))
        for a, b in row_slices(offsets, 8 << 20):
            row, terms = _terms(data, offsets[a:b + 1])
            if not len(row):
                continue
            names, width = terms.dictionary, len(terms.dictionary)
            _, start, in_row = _runs(row * width + terms.indices.to_numpy())
            often = np.diff(np.append(start, len(row)))
            order, start, both = _runs(group[a:b][in_row // width] * width + in_row % width)
            yield rows(both // width, names.take(pa.array(both % width)).cast(pa.string()),
                       np.add.reduceat(often[order], start), np.diff(np.append(start, len(order))))


def share(count: np.ndarray, total, kept: int) -> np.ndarray:
    """``1 + floor(UNIT (count + 2) / (total + 2 kept))``, exact: in wider integers where 64 bits are too few."""
    count, total = np.asarray(count, np.int64), np.asarray(total, np.int64)
    if count.max(initial=0) < (1 << 62) // UNIT:
        return 1 + UNIT * (count + 2) // (total + 2 * kept)
    return (1 + UNIT * (count.astype(object) + 2) // (total.astype(object) + 2 * kept)).astype(np.int64)


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _audit(top: int):
    """One slice of one language: partial sums of its pairs of groups, and the leading terms of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        groups = table.filter(pc.is_null(table["term"])).sort_by("source")
        names, many = groups["source"].combine_chunks(), len(groups)
        kept, lang_total = groups["v"][0].as_py(), groups["lang_total"][0].as_py()
        total = groups["n"].to_numpy()
        posted = table.filter(pc.is_valid(table["term"]))
        n = posted["n"].to_numpy()
        who = pc.index_in(posted["source"], value_set=names).to_numpy().astype(np.int64)
        terms = posted["term"].combine_chunks().dictionary_encode()
        term, words = terms.indices.to_numpy().astype(np.int64), terms.dictionary
        p = share(n, total[who], kept) if kept else n
        zero = share(np.zeros(many), total, kept) if kept else np.zeros(many, np.int64)

        # Leading terms: those above the language's share.
        if len(n):
            whole = np.zeros(len(words), np.int64)
            np.add.at(whole, term, n)
            q = share(whole, lang_total, kept)[term]
            place = np.argsort(np.argsort(np.array([w.encode() for w in words.to_pylist()], object)))
            above = np.flatnonzero((p > q) & (n > 0))
            value = apart(p, q)[above]
            order = np.lexsort((place[term[above]], -value, who[above]))
            above, value = above[order], value[order]
            start = np.searchsorted(who[above], np.arange(many))
            lead = np.arange(len(above)) - start[who[above]] < top
            above, value = above[lead], value[lead]
            yield pa.RecordBatch.from_arrays([
                names.take(pa.array(who[above])), pa.array(["term"] * len(above), pa.string()), words.take(pa.array(term[above])).cast(pa.string()),
                pa.array(value)], schema=PARTS)

        # The term-major index, each group's terms, and for each group how many terms have which share.
        by_term = np.argsort(term, kind="stable")
        first = np.searchsorted(term[by_term], np.arange(len(words) + 1))
        peer, peer_p = who[by_term], p[by_term]
        order, start, at = _runs(who * (2 * UNIT + 4) + p)
        often, own_of, own_p = np.diff(np.append(start, len(order))), at // (2 * UNIT + 4), at % (2 * UNIT + 4)
        by_group = np.argsort(who, kind="stable")
        bound = np.searchsorted(who[by_group], np.arange(many + 1))
        edge = np.searchsorted(own_of, np.arange(many + 1))
        for g in range(many):
            sums = np.zeros(many, np.int64)
            if kept and len(words):
                both = apart(zero[g], zero)
                sums += len(words) * both
                for u, c in zip(own_p[edge[g]:edge[g + 1]], often[edge[g]:edge[g + 1]]):
                    sums += c * (apart(u, zero) - both)
                np.add.at(sums, own_of, often * (apart(zero[g], own_p) - both[own_of]))
                mine = by_group[bound[g]:bound[g + 1]]
                length = first[term[mine] + 1] - first[term[mine]]
                along = np.repeat(first[term[mine]] - np.cumsum(length) + length, length) + np.arange(length.sum())
                at, mine_p = peer[along], np.repeat(p[mine], length)
                np.add.at(sums, at, apart(mine_p, peer_p[along]) - apart(mine_p, zero[at]) - apart(zero[g], peer_p[along]) + both[at])
            others = np.flatnonzero(np.arange(many) != g)
            yield pa.RecordBatch.from_arrays([
                names.take(pa.array(np.full(len(others), g))), pa.array(["pair"] * len(others), pa.string()), names.take(pa.array(others)),
                pa.array(sums[others])], schema=PARTS)

    def typed(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0].as_py()] * len(batch), pa.string()), *batch.columns], names=["lang", *batch.schema.names])

    def named(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return typed(key, batches)

    return named


def divergence(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
               least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language, part ``term``
    the ``top`` kept terms that the source uses more than its language; the greatest divergence comes first."""
    clean = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    counts = stage(
        docs.select(clean(text_col, "text"), clean(lang_col, "lang"), clean(source_col, "source"))
        .mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    same = Window.partitionBy("lang", "term")
    kept = stage(
        counts.where("term IS NOT NULL")
        .withColumn("df", F.sum("docs").over(same)).withColumn("at", F.row_number().over(same.orderBy("source")))
        .where(F.col("df") >= least_docs).select("lang", "source", "term", "n", (F.col("at") == 1).cast("long").alias("first")))
    groups = counts.where("term IS NULL").select("lang", "source").join(
        kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("first"), F.count("*").alias("postings")),
        ["lang", "source"], "left").fillna(0)
    langs = stage(
        groups.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("first").alias("v"), F.sum("postings").alias("postings"))
        .withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("postings") / SLICE_POSTINGS)).cast("int")).drop("postings"))
    posted = kept.join(langs, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"), "source", "term", "n", "v", "lang_total")
    rows = groups.join(langs, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "source", F.lit(None).cast("string").alias("term"),
        "n", "v", "lang_total")
    found = posted.unionByName(rows).groupBy("lang", "slice").applyInArrow(
        _audit(top), "lang string, source string, part string, item string, value long")
    whole = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return whole.withColumn("rank", F.row_number().over(order)).where(
        (F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
