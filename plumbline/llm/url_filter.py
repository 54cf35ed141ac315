"""URL verdicts by a Bloom filter cascade, in DataFrame functions only.

A rule is a host and a path start; its key is the two joined. A URL is asked for the keys that a rule could have:
its last labels (as many as some rule's host has) with the first characters of its path (as many as some rule's
path has). Level 1 of a cascade holds the listed keys and is built so large that about as many keys of the corpus
pass it by mistake as there are rules. Level 2 holds exactly those mistakes, found among all keys of the corpus;
level 3 the listed keys that level 2 takes for mistakes; and so on until a level makes none. From then on
membership is exact for every key of the corpus, by bit tests alone: the pages are joined with nothing. The list of
blocked keys and that of allowed keys have a cascade each; of a URL's listed keys the longest decides.

What goes to every task grows with the rules and not with the pages: about 1.44 log2(keys / rules) bits a rule on
level 1, 1.44 on the others. ``MAX_RULES`` bounds it (some 8 MB).

Defined results: host and path are empty where the URL is null or has no ``://``; only A-Z are lower-cased; a rule
without a host, or whose path neither is empty nor starts with ``/``, fits nothing; a null path is an empty one, a
rule's verdict other than ``allow`` blocks, and a key listed both ways blocks; a URL that no rule fits is not on
the block list, so it is allowed. Repeated pages are judged each; an empty table, or no rules, gives a result of
the same form; other columns are ignored, whatever their names; URLs of any length are read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_RULES = 1 << 20


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``words`` of 64 bits, ``hashes`` positions a key, seeds from ``seed`` on."""

    seed: int
    hashes: int
    words: tuple[int, ...]

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed + i)), F.lit(len(self.words) * 64)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        # One literal for all words; the cast is folded once, on the driver.
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        test = F.lit(True)
        for place in self.places(key):
            word = F.get(words, F.shiftright(place, 6).cast("int"))
            test = test & (F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return test

    @staticmethod
    def build(keys: DataFrame, count: int, hashes: int, seed: int) -> Level:
        """The filter of the distinct ``keys``; ``count`` is their number, at most a small multiple of the rules."""
        size = max(1, math.ceil(count * hashes * math.log2(math.e) / 64))
        empty = Level(seed, hashes, (0,) * size)
        place = F.col("place")
        filled = (
            keys.select(F.explode(F.array(*empty.places(F.col("key")))).alias("place"))
            .groupBy(F.shiftright(place, 6).alias("at"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("word"))
            .collect()  # at most ``size`` rows
        )
        words = [0] * size
        for row in filled:
            words[row["at"]] = row["word"]
        return Level(seed, hashes, tuple(words))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed: an odd level says yes until the next one objects."""
        answer = F.lit(False)
        for level in reversed(self.levels):
            answer = level.holds(key) & ~answer
        return answer


def build_cascade(listed: DataFrame, universe: DataFrame, universe_size: int, seed: int) -> Cascade:
    """``listed`` (distinct keys) against ``universe`` (keys, repeated or not; both have the column ``key``).

    ``universe_size`` decides the size of level 1 only, so that any upper bound will do.
    """
    listed = stage(listed)
    count = listed.count()
    if not count:
        return Cascade(())
    hashes = max(1, math.ceil(math.log2(max(2.0, universe_size * math.sqrt(2) / count))))
    levels = [Level.build(listed, count, hashes, seed)]
    passed = universe.where(levels[0].holds(F.col("key"))).select("key").distinct()
    inside, outside = listed, stage(passed.join(listed, "key", "left_anti"))
    count = outside.count()
    while count:
        seed += levels[-1].hashes
        levels.append(Level.build(outside, count, 1, seed))
        # What the new level takes for its own among the other side goes into the next one.
        inside, outside = outside, stage(inside.where(levels[-1].holds(F.col("key"))))
        count = outside.count()
    return Cascade(tuple(levels))


@dataclass(frozen=True)
class UrlFilter:
    block: Cascade
    allow: Cascade
    shapes: tuple[tuple[int, int], ...]  # (labels of the host, characters of the path) that rules have

    def judge(self, pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
        """Per page: its id, host, path, the key of the rule that decides, and the verdict."""
        urls = pages.select(F.col(id_col), F.col(url_col).cast("string").alias(f"{id_col}_url")).select(
            F.col(id_col), host_of(F.col(f"{id_col}_url")).alias(f"{id_col}_host"), path_of(F.col(f"{id_col}_url")).alias(f"{id_col}_path"))
        host, path = F.col(f"{id_col}_host"), F.col(f"{id_col}_path")
        found = F.filter(candidates(host, path, self.shapes), lambda k: self.block.holds(k["key"]) | self.allow.holds(k["key"]))
        judged = urls.select(id_col, host, path, F.array_max(found)["key"].alias(f"{id_col}_rule"))
        rule = F.col(f"{id_col}_rule")
        blocked = F.coalesce(self.block.holds(rule), F.lit(False))
        return judged.select(
            id_col, host.alias("host"), path.alias("path"), rule.alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"))


def candidates(host: Column, path: Column, shapes) -> Column:
    """The keys of a URL that a rule could have, as structs that are greater the longer the key."""
    if not shapes:
        return F.array().cast("array<struct<length:int,labels:int,key:string>>")
    known = F.from_json(
        F.lit("[" + ",".join(f'{{"labels":{d},"length":{n}}}' for d, n in shapes) + "]"), "array<struct<labels:int,length:int>>")
    labels = F.size(F.split(host, r"\.", -1))
    fitting = F.filter(known, lambda s: (s["labels"] <= labels) & (s["length"] <= F.length(path)))

    def key(shape):
        name = F.call_function("substring_index", host, F.lit("."), -shape["labels"])
        joined = F.concat(name, F.substring(path, F.lit(1), shape["length"]))
        return F.struct(F.length(joined).alias("length"), shape["labels"].alias("labels"), joined.alias("key"))

    return F.transform(fitting, key)


def build_filter(rules: DataFrame, pages: DataFrame, *, url_col: str = "url") -> UrlFilter:
    """Fit both cascades of ``rules`` (host, path, verdict) to all keys of ``pages``."""
    path = F.coalesce(F.col("path").cast("string"), F.lit(""))
    listed = stage(
        rules.select(F.translate(F.col("host").cast("string"), UPPER, LOWER).alias("host"), path.alias("path"),
                     F.coalesce(F.col("verdict") != "allow", F.lit(True)).alias("blocks"))
        .where("host != '' AND (path = '' OR path LIKE '/%')")
        .groupBy("host", "path").agg(F.max("blocks").alias("blocks"))
        .select(F.concat("host", "path").alias("key"), "blocks",
                F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("length")))
    count = listed.count()
    if count > MAX_RULES:
        raise ValueError(f"{count} rules: the filters that every task holds are made for {MAX_RULES} at most")
    shapes = tuple(sorted((r["labels"], r["length"]) for r in listed.select("labels", "length").distinct().collect()))  # one row a rule at most
    url = F.col(url_col).cast("string")
    universe = pages.select(F.explode(candidates(host_of(url), path_of(url), shapes)).alias("asked")).select(F.col("asked")["key"].alias("key"))
    size = pages.count() * max(1, len(shapes))
    block = build_cascade(listed.where("blocks").select("key"), universe, size, seed=1)
    allow = build_cascade(listed.where("NOT blocks").select("key"), universe, size, seed=100_001)
    return UrlFilter(block, allow, shapes)
