"""Ordering of hot keys equals the plain window, whatever the order looks like, and spreads over tasks."""

import random

import pytest
from pyspark.sql import Window, functions as F

from plumbline.operators import ranking


def frame(spark, spread):
    """More than half of the rows in one key; with ``spread`` 1 all of them at the same moment."""
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}", rng.randrange(spread), n, rng.choice([None, None, n])) for n in range(600)]
    return spark.createDataFrame(rows, "k string, at bigint, seq bigint, v bigint").cache()


def same(a, b, columns):
    key = lambda r: tuple(str(x) for x in r)
    return sorted(map(tuple, a.select(*columns).collect()), key=key) == sorted(map(tuple, b.select(*columns).collect()), key=key)


@pytest.mark.parametrize("bound", [10_000, 100, 5])
@pytest.mark.parametrize("spread", [1, 300])
def test_equals_the_plain_window(spark, bound, spread):
    df, order = frame(spark, spread), [F.col("at"), F.col("seq")]
    window = Window.partitionBy("k").orderBy("at", "seq")
    got = ranking.row_number(df, ["k"], order, bound=bound)
    assert same(got, df.withColumn("rn", F.row_number().over(window)), ["k", "seq", "rn"])
    before = ranking.last_before(df, ["k"], order, F.col("v"), "x", bound=bound)
    assert same(before, df.withColumn("x", F.last("v", True).over(window.rowsBetween(Window.unboundedPreceding, -1))), ["k", "seq", "x"])
    after = ranking.first_after(df, ["k"], order, F.col("v"), "x", bound=bound)
    assert same(after, df.withColumn("x", F.first("v", True).over(window.rowsBetween(1, Window.unboundedFollowing))), ["k", "seq", "x"])


def test_expressions_and_known_hot_keys(spark):
    df = frame(spark, 50)
    hot = spark.createDataFrame([("hot",), ("absent",)], "k string")
    order = [-F.col("at"), F.col("seq")]
    window = Window.partitionBy("k", "v2").orderBy(F.desc("at"), "seq")
    df = df.withColumn("v2", F.col("seq") % 2)
    assert same(ranking.row_number(df, ["k", "v2"], order, hot=hot), df.withColumn("rn", F.row_number().over(window)), ["k", "seq", "rn"])
    empty = df.limit(0)
    assert ranking.row_number(empty, ["k"], order).count() == 0


def test_one_busy_moment_spreads_over_tasks(spark):
    """A third of all rows in one key and one second: no range holds much more than the others."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string"))).alias("k"),
        F.lit(0).alias("at"), F.hash("id").alias("seq"), F.col("id").alias("v"))
    hot = ranking.hot_keys(df, ["k"], 1000)
    assert [r.k for r in hot.collect()] == ["hot"]
    sizes = [r["count"] for r in ranking._placed(df, ["k"], [F.col("at"), F.col("seq")], hot).groupBy("k", ranking.PART).count().collect()]
    assert len(sizes) >= 24 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
