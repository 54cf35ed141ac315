"""Ordered operators that never put a whole hot key into one task.

A plain window over a key sorts the key's rows in one task, which fails when one key holds a third of the data.
A first pass counts the rows of each key. Keys of at most ``bound`` rows go through the plain window. The rows of
the others are sorted across tasks: Spark samples them and picks split points among their own (key, order) values,
so the ranges come out even whatever the clock says, a key with all its rows in one second included. Rows keep
their places, and only one summary row per (key, range) is ordered over the whole key. The results equal the plain
window's. Keys must not be null, and ``order`` lists plain columns or expressions, ascending.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.session import stage

BOUND = 1_000_000
#: Ranges for each shuffle partition: so many that a few hot keys still spread evenly when dealt by hash.
RANGES = 8
AT, PART = "__at", "__part"


def hot_keys(df: DataFrame, keys: Sequence[str], bound: int = BOUND) -> DataFrame | None:
    """The keys with more than ``bound`` rows (at most rows / bound of them), or None."""
    hot = stage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > bound).drop("__n"))
    return None if hot.isEmpty() else hot


def _apart(df: DataFrame, hot: DataFrame | None) -> DataFrame:
    """The rows of all other keys."""
    return df if hot is None else df.join(hot, hot.columns, "left_anti")


def _placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column], hot: DataFrame) -> DataFrame:
    """The rows of hot keys, sorted across even ranges, with their place and range. Written, so that places are final."""
    ranges = RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.join(hot, hot.columns, "left_semi").repartitionByRange(ranges, *keys, *order).sortWithinPartitions(*keys, *order)
    return stage(rows.withColumn(AT, F.monotonically_increasing_id())).withColumn(PART, F.shiftright(AT, 33))


def row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn", bound: int = BOUND, hot: DataFrame | None | bool = True,
) -> DataFrame:
    """``row_number()`` over ``keys`` by ``order``.

    ``hot`` gives the keys (or some columns of keys) that are hot, or None, where the caller has counted already.
    """
    hot = hot_keys(df, keys, bound) if hot is True else hot
    plain = _apart(df, hot).withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    if hot is None:
        return plain
    placed = _placed(df, keys, order, hot)
    heads = stage(placed.groupBy(*keys, PART).agg(F.min(AT).alias("__first"), F.count(F.lit(1)).alias("__n")))
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = heads.withColumn("__offset", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    numbered = placed.join(offsets, [*keys, PART]).withColumn(name, (F.col(AT) - F.col("__first") + F.col("__offset") + 1).cast("long"))
    return plain.unionByName(numbered.select(*plain.columns))


def _carry(df, keys, order, value, name, bound, hot, forward: bool) -> DataFrame:
    hot = hot_keys(df, keys, bound) if hot is True else hot
    ahead = Window.unboundedPreceding, -1
    last = lambda column, window: F.last(column, ignorenulls=True).over(window.rowsBetween(*ahead))
    ordered = [F.asc(c) if forward else F.desc(c) for c in (f"__o{i}" for i in range(len(order)))]
    keyed = _apart(df, hot).withColumns({f"__o{i}": c for i, c in enumerate(order)} | {"__v": value})
    plain = keyed.withColumn(name, last("__v", Window.partitionBy(*keys).orderBy(*ordered))).select(*df.columns, name)
    if hot is None:
        return plain
    placed = _placed(df.withColumn("__v", value), keys, order, hot)
    way = F.asc if forward else F.desc
    pick = F.max_by if forward else F.min_by
    # One row per range: its outermost value, null when it has none.
    edges = stage(placed.groupBy(*keys, PART).agg(pick("__v", F.when(F.col("__v").isNotNull(), F.col(AT))).alias("__edge")))
    carried = edges.withColumn("__carried", last("__edge", Window.partitionBy(*keys).orderBy(way(PART)))).drop("__edge")
    inside = Window.partitionBy(*keys, PART).orderBy(way(AT))
    rows = placed.join(carried, [*keys, PART]).withColumn(name, F.coalesce(last("__v", inside), F.col("__carried")))
    return plain.unionByName(rows.select(*plain.columns))


def last_before(df: DataFrame, keys, order, value: Column, name: str, bound: int = BOUND, hot: DataFrame | None | bool = True) -> DataFrame:
    """The last non-null ``value`` strictly before each row."""
    return _carry(df, keys, order, value, name, bound, hot, True)


def first_after(df: DataFrame, keys, order, value: Column, name: str, bound: int = BOUND, hot: DataFrame | None | bool = True) -> DataFrame:
    """The first non-null ``value`` strictly after each row."""
    return _carry(df, keys, order, value, name, bound, hot, False)
