"""What an executor's Python workers hold: one worker a task in near_duplicates, and tables no longer than needed."""

import numpy as np
import pytest

from plumbline.llm import near_dedup, words


def chained(plan):
    """The most Python steps that one task of a plan runs: those on a path down to the next exchange."""
    most, path = 0, []
    for line in plan.splitlines():
        node = line.lstrip(" :+-*")
        depth = len(line) - len(node)
        path = [x for x in path if x[0] < depth]
        path.append((depth, node))
        count = 0
        for _, name in reversed(path):
            if "Exchange" in name.split("(")[0]:
                break
            count += "MapInArrow" in name.split("(")[0]
        most = max(most, count)
    return most


def test_chained():
    assert chained("Project\n+- MapInArrow f(x)\n   +- BroadcastHashJoin\n      :- MapInArrow g(x)\n      +- BroadcastExchange\n         +- MapInArrow h(x)") == 2
    assert chained("MapInArrow f(x)\n+- Exchange\n   +- MapInArrow g(x)") == 1


def test_a_task_has_one_worker(spark, monkeypatch):
    plans, real = [], near_dedup.stage

    def staged(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(near_dedup, "stage", staged)
    base = [" ".join(f"{i}w{n}" for n in range(40)) for i in range(6)]
    rows = [(10 * i + j, t + " more" * j) for i, t in enumerate(base) for j in range(2)] + [(99, None), (98, "")]
    got = {r["id"]: r["component"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: n // 10 * 10 if n < 90 else n for n, _ in rows}
    assert max(map(chained, plans)) == 1


@pytest.mark.parametrize("order", [(10, 70_000, 300), (70_000, 10, 300)])
def test_powers_follow_the_texts(monkeypatch, order):
    monkeypatch.setattr(words, "_POWERS", [])
    for n in order:
        power, inverse = words.powers(n)
        assert n <= len(power) == len(inverse) <= max(order) + words.POWER_STEP
        assert (power * inverse == np.uint64(1)).all() and power[0] == 1 and power[1] == np.uint64(words._RATE)
