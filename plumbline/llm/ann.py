"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Vectors of one direction (equal when divided by their lengths) are one node, with the few smallest ids that a
result can show, so copies and exact multiples neither crowd a graph nor a task. Nodes are dealt to shards of about ``shard_size`` by a hash of the vector. A shard's graph starts
at random; in two passes each node searches greedily for itself, and what it met is pruned: the nearest stays,
and what lies closer to it by the factor alpha than to the node goes (alpha 1, then 1.2). Reverse edges are
pruned alike. Then a beam search answers each query in each shard, and the shards' answers are merged. Every
vector is indexed; scores are cosines of the original vectors in double precision, and ties among all that the beam
holds go to the smaller id.

Defined results: vectors that are null, zero or hold null, NaN or infinite parts take no part, nor do rows
without an id; equal rows count once; an id with several vectors is a candidate with each, a query with each,
and never its own neighbour; vectors are only compared with vectors of the same length; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Entry nodes of a graph; several keep groups of close vectors from walling off the rest.
ENTRIES = 16


def _search(unit, edges, entry, queries, beam):
    """Greedy beam search of many queries at once: (ids, squared distances) of the beam, and all nodes met."""
    many, n = len(queries), len(unit)
    beam = min(beam, n)
    ids, far = np.full((many, beam), -1), np.full((many, beam), np.inf)
    open_ = np.zeros((many, beam), bool)
    met = np.zeros((many, n), bool)
    entry = entry[:beam]
    starts = 2 - 2 * queries @ unit[entry].T
    order = np.argsort(starts, axis=1, kind="stable")
    ids[:, :len(entry)], far[:, :len(entry)] = entry[order], np.take_along_axis(starts, order, axis=1)
    open_[:, :len(entry)] = True
    met[:, entry] = True
    rows = np.arange(many)
    while len(rows):
        at = open_[rows].argmax(axis=1)
        rows = rows[open_[rows, at]]
        if not len(rows):
            break
        at = open_[rows].argmax(axis=1)
        now = ids[rows, at]
        open_[rows, at] = False
        near = edges[now]
        fresh = (near >= 0) & ~met[rows[:, None], near]
        distance = np.where(fresh, 2 - 2 * np.einsum("qd,qrd->qr", queries[rows], unit[near]), np.inf)
        r, c = np.nonzero(fresh)
        met[rows[r], near[r, c]] = True
        every = np.concatenate([far[rows], distance], axis=1)
        order = np.argsort(every, axis=1, kind="stable")[:, :beam]
        far[rows] = np.take_along_axis(every, order, axis=1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], near], axis=1), order, axis=1)
        open_[rows] = np.take_along_axis(np.concatenate([open_[rows], fresh], axis=1), order, axis=1) & np.isfinite(far[rows])
    return ids, far, met


def _prune(unit, nodes, candidates, alpha, degree):
    """Robust pruning of padded candidate rows (-1 is padding): the kept neighbours of each node, padded."""
    own = unit[nodes]
    given = candidates >= 0
    given &= candidates != nodes[:, None]
    distance = np.where(given, 2 - 2 * np.einsum("bd,bcd->bc", own, unit[candidates]), np.inf)
    order = np.argsort(distance, axis=1, kind="stable")
    candidates, distance = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(distance, order, axis=1)
    candidates[:, 1:][(candidates[:, 1:] == candidates[:, :-1])] = -1
    vectors = unit[candidates]
    alive = np.isfinite(distance) & (candidates >= 0)
    kept = np.full((len(nodes), degree), -1)
    rows = np.arange(len(nodes))
    for step in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        kept[some, step] = candidates[rows, first][some]
        between = 2 - 2 * np.einsum("bd,bcd->bc", vectors[rows, first], vectors)
        alive &= ~((alpha * alpha * between <= distance) & some[:, None])
        alive[rows, first] = False
    return kept


def build_graph(unit: np.ndarray, degree: int = 32, beam: int = 64, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Edges (n, degree) padded with -1, and the entry nodes: the one nearest to the mean and a few at random."""
    n = len(unit)
    if n <= degree + 1:
        every = np.arange(n)
        edges = np.array([[j for j in every if j != i] + [-1] * (degree - n + 1) for i in every]).reshape(n, degree)
        return edges, np.arange(min(n, 1))
    random = np.random.default_rng(seed)
    edges = random.integers(0, n, (n, degree))
    edges[edges == np.arange(n)[:, None]] = -1
    middle = (unit @ unit.mean(axis=0)).argmax()
    entry = np.unique(np.concatenate([[middle], random.integers(0, n, ENTRIES - 1)]))
    for alpha in (1.0, 1.2):
        order = random.permutation(n)
        for a in range(0, n, 256):
            nodes = order[a:a + 256]
            ids, _, _ = _search(unit, edges, entry, unit[nodes], beam)
            edges[nodes] = kept = _prune(unit, nodes, np.concatenate([ids, edges[nodes]], axis=1), alpha, degree)
            # Reverse edges: targets take the new sources into account and are pruned again.
            source, target = np.repeat(nodes, degree), kept.ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            unique, start, count = np.unique(target, return_index=True, return_counts=True)
            wide = np.full((len(unique), int(count.max(initial=0))), -1)
            place = np.arange(len(target)) - np.repeat(start, count)
            wide[np.repeat(np.arange(len(unique)), count), place] = source
            for b in range(0, len(unique), 256):
                some = unique[b:b + 256]
                edges[some] = _prune(unit, some, np.concatenate([edges[some], wide[b:b + 256]], axis=1), alpha, degree)
    return edges, entry


def _shard(k: int, beam: int):
    def run(nodes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = {"query_id": [], "query": [], "vec_id": [], "score": []}
        if len(nodes) and len(queries):
            vectors = np.stack(nodes["vector"].to_numpy()).astype(np.float64)
            norms = np.linalg.norm(vectors, axis=1)
            unit = vectors / norms[:, None]
            edges, entry = build_graph(unit)
            ids_of, own, name = nodes["ids"].to_numpy(), queries["query_id"].to_numpy(), queries["query"].to_numpy()
            for a in range(0, len(queries), 512):
                asked = np.stack(queries["vector"].iloc[a:a + 512].to_numpy()).astype(np.float64)
                lengths = np.linalg.norm(asked, axis=1)
                found, _, _ = _search(unit, edges, entry, asked / lengths[:, None], beam)
                for i, row in enumerate(found):
                    row = row[row >= 0]
                    scores = vectors[row] @ asked[i] / (norms[row] * lengths[i])
                    # All nodes of the beam that tie with the last place stay in: ids decide among them. The vector of
                    # the query itself may be one of the first.
                    if len(row) > k + 1:
                        near = scores >= np.partition(scores, -k - 1)[-k - 1]
                        row, scores = row[near], scores[near]
                    best = sorted((-s, int(v)) for s, r in zip(scores.tolist(), row) for v in ids_of[r] if v != own[a + i])[:k]
                    columns["query_id"] += [own[a + i]] * len(best)
                    columns["query"] += [name[a + i]] * len(best)
                    columns["vec_id"] += [v for _, v in best]
                    columns["score"] += [-s for s, _ in best]
        return pd.DataFrame(columns).astype({"query_id": "int64", "query": "int64", "vec_id": "int64", "score": "float64"})

    return run


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Distinct (id, vector) that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(
        "id IS NOT NULL AND vector IS NOT NULL").where(~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0)).distinct()


def nearest(candidates: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding",
            k: int = 5, beam: int = 128, shard_size: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each query, nearest first, ties to the smaller id."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    rows = usable(candidates, id_col, vector_col).withColumn("length", length)
    # Vectors of one direction are one node; a length that under- or overflows stands for itself.
    scaled = (F.col("length") > 0) & (F.col("length") < float("inf"))
    rows = rows.withColumn("way", F.when(scaled, F.transform("vector", lambda x: x / F.col("length"))).otherwise(F.col("vector")))
    first = Window.partitionBy("way").orderBy("id")
    nodes = (
        rows.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)
        .groupBy("way").agg(F.min_by("vector", "id").alias("vector"), F.collect_list("id").alias("ids")))
    shards = max(1, -(-candidates.count() // shard_size))
    nodes = nodes.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vector"), F.lit(shards)).alias("shard"), "vector", "ids")
    asked = usable(queries, id_col, vector_col).select(
        F.size("vector").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")).alias("shard"),
        "vector", F.col("id").alias("query_id"), F.xxhash64("vector").alias("query"))
    found = nodes.groupBy("dim", "shard").cogroup(asked.groupBy("dim", "shard")).applyInPandas(
        _shard(k, beam), "query_id long, query long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    one = found.groupBy("query_id", "query", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
