"""Connected components against brute force, and the rounds that they take."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import components as graph


@pytest.fixture
def steps(monkeypatch):
    """The star steps that were taken."""
    taken, real = [], graph._star

    def counted(edges, large):
        taken.append(large)
        return real(edges, large)

    monkeypatch.setattr(graph, "_star", counted)
    return taken


def brute(edges):
    least = {v: v for e in edges for v in e if e[0] != e[1]}
    for a, b in edges:
        if a != b and least[a] != least[b]:
            low, high = sorted((least[a], least[b]))
            least = {v: low if m == high else m for v, m in least.items()}
    return least


def found(spark, edges):
    labels = graph.components(spark.createDataFrame(edges, "a long, b long"))
    rows = [tuple(r) for r in labels.select("v", "component").collect()]
    assert len(rows) == len(dict(rows))
    return labels, dict(rows)


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(400 + i, 401 + i) for i in range(20)] + [(500, 0)] * 2 + [(600, 600)]
    labels, got = found(spark, edges)
    assert got == brute(edges)
    further = [(r.randrange(450), r.randrange(700)) for _ in range(40)]
    again = graph.components(labels.select(F.col("v").alias("a"), F.col("component").alias("b")).union(spark.createDataFrame(further, "a long, b long")))
    assert {x["v"]: x["component"] for x in again.collect()} == brute(edges + further)


def test_stars_take_no_round(spark, steps):
    edges = [(i % 5, i) for i in range(5, 60)] + [(3, 3)]
    labels, got = found(spark, edges)
    assert got == brute(edges) and not steps
    graph.components(labels.select(F.col("v").alias("a"), F.col("component").alias("b")))
    assert not steps
    assert found(spark, [])[1] == {} and not steps
    assert found(spark, edges + [(4, 59), (3, 59)])[1] == brute(edges + [(4, 59), (3, 59)]) and steps


def test_simple_copies_take_no_round(spark, steps):
    from plumbline.llm.near_dedup import near_duplicates

    words = [f"{i}w{n}" for i in range(4) for n in range(30)]
    rows = [(10 * i + j, " ".join([*words[30 * i:30 * i + 30], *["more"] * j])) for i in range(4) for j in range(2)] + [(99, None)]
    got = {r["id"]: r["component"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: n // 10 * 10 if n < 99 else 99 for n, _ in rows} and not steps
