"""Divergence audit, URL filter and hard negatives against brute force, with the awkward cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import divergence, hard_negatives as hn, registry, url_filter as uf

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


# ---------------------------------------------------------------- divergence

def audit_brute(rows, least_docs, top=10):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(lang or "", source or "", Counter(term.findall((text or "").translate(LOW)))) for text, lang, source in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        df[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for t, n in df[lang].items() if n >= least_docs)
        sources = sorted({d[1] for d in docs if d[0] == lang})
        v = len(kept)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * v) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", sorted(own, key=lambda x: (-x[0], x[1].encode()))[:top])):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def audit_rows():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcXYZéß漢😀") for _ in range(r.randint(1, 4))) for _ in range(60)]
    rows = [(None, None, None), ("", "en", "quiet"), ("12 34 ...", "en", "digits"), ("rare", "xx", "alone"), ("rare", "xx", "other"), (None, "en", None)]
    for _ in range(140):
        words = [r.choice(vocab[:30 if r.random() < 0.7 else 60]) for _ in range(r.randint(1, 40))]
        rows.append((r.choice([" ", "_", "-7 "]).join(words), r.choice(["en", "en", "de", None]), r.choice(["a", "b", "b", "B", "é", None])))
    return rows + rows[20:24] * 2 + [("the End " * 30_000 + vocab[0], "en", "long")]


AUDIT = "text string, lang string, source string"


@pytest.mark.parametrize("postings", [1 << 17, 7])
def test_divergence(spark, monkeypatch, postings):
    monkeypatch.setattr(divergence, "SLICE_POSTINGS", postings)
    rows = audit_rows()
    docs = spark.createDataFrame(rows, AUDIT).withColumns({"term": F.lit(1), "n": F.lit("x"), "item": F.lit(2), "docs": F.lit(0)}).repartition(5)
    got = divergence.divergence(docs, least_docs=4)
    assert sorted(map(tuple, got.collect())) == audit_brute(rows, 4)


def test_divergence_edges(spark):
    assert divergence.divergence(spark.createDataFrame([], AUDIT)).count() == 0
    rows = [(None, "en", "a"), ("x", "en", "b"), (None, None, None)]
    assert sorted(map(tuple, divergence.divergence(spark.createDataFrame(rows, AUDIT)).collect())) == audit_brute(rows, 10)


def test_shares_are_exact():
    counts = np.array([0, 1, 5 * 10**9, 10**12])
    assert divergence.share(counts, 10**13, 10**6).tolist() == [1 + 10**9 * (int(c) + 2) // (10**13 + 2 * 10**6) for c in counts]


# ---------------------------------------------------------------- URL filter

def judge_brute(url, rules):
    low = (url or "").find("://")
    if low < 0:
        return "", "", None, "allow"
    rest = url[low + 3:]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = host.translate(LOW)
    fits = [(len(h + p), h.count("."), h + p) for h, p, _ in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    key = max(fits)[2]
    return host, path, key, "block" if any(v != "allow" for h, p, v in rules if h + p == key) else "allow"


def urls():
    r = random.Random(9)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "a.b.c.net", "net", "xnet", "com", "example.com.", ".net", "", "m.örg.net", "ÄÖ.net", "h:80"]
    paths = ["", "/", "/en", "/en/", "/en/x.html", "/EN/", "/fr/?q=://x/", "/es/#/fr/", "?/en/", "#", "/" + "y" * 3000]
    some = [f"{s}://{h}{p}" for s in ("http", "x\ny", "") for h in hosts for p in paths]
    some += [f"https://h{r.randrange(400)}.site{r.randrange(60)}.org/p{r.randrange(90)}/{i}" for i in range(3000)]
    return some + [None, "", "no scheme", "a:/b", "://net/fr/1", "http://net/fr/1", "http://net/fr/1"]


def judged(spark, rules):
    pages = spark.createDataFrame(list(enumerate(urls())), "page_id long, url string").withColumns({c: F.lit(c) for c in ("host", "path", "rule", "key")})
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    fitted = uf.build_filter(table, pages)
    return fitted, {r[0]: tuple(r)[1:] for r in fitted.judge(pages).select("page_id", "host", "path", "rule", "verdict").collect()}


def test_url_rules(spark):
    _, got = judged(spark, registry.URL_RULES)
    assert got == {i: judge_brute(u, registry.URL_RULES) for i, u in enumerate(urls())}


def test_url_filter_of_many_rules(spark):
    r = random.Random(2)
    rules = [(f"site{i}.org", f"/p{r.randrange(90)}", r.choice(["block", "allow", None])) for i in range(60) for _ in range(6)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values()) + [("h7.site3.org", "", "allow"), ("com", "/", "block"), ("com", "/", "allow")]
    fitted, got = judged(spark, [*rules, (None, "/", "block"), ("", "/", "block"), ("net", "fr", "block"), ("ORG", None, "allow")])
    want = [*rules, ("org", "", "allow")]
    assert got == {i: judge_brute(u, want) for i, u in enumerate(urls())}
    assert len(fitted.block.levels) >= 2 and len(fitted.block.levels[0].words) < 200


def test_cascade_alternates(spark):
    # A size far too small for the universe makes many mistakes on level 1; the levels behind it mend them all.
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 20_000, 7).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = uf.build_cascade(listed, universe, 1, seed=1)
    assert len(cascade.levels) > 4
    found = universe.where(cascade.holds(F.col("key")))
    assert found.count() == listed.count() and found.join(listed, "key", "left_anti").count() == 0


def test_url_filter_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(registry.URL_RULES, "host string, path string, verdict string")
    assert uf.build_filter(rules, none).judge(none).columns == ["page_id", "host", "path", "rule", "verdict"]
    pages = spark.createDataFrame([(1, "http://net/fr/")], "page_id long, url string")
    assert [tuple(r) for r in uf.build_filter(rules.limit(0), pages).judge(pages).collect()] == [(1, "net", "/fr/", None, "allow")]


# ---------------------------------------------------------------- hard negatives

def mined_brute(rows, anchor, k=5, m=3):
    good = {(i, l, tuple(int(np.floor(256 * float(x))) for x in v)) for i, l, v in rows
            if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, label, v in good:
        if not anchor(i):
            continue
        met = [(-sum(a * b for a, b in zip(v, w)), j, w, lab) for j, lab, w in good if j != i and len(w) == len(v)]
        for s, j, _, _ in sorted(x for x in met if x[3] == label)[:k]:
            fits = sorted(x for x in met if x[3] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)[:m]
            out += [(i, j, rank, n[1], -s, -n[0]) for rank, n in enumerate(fits, 1)]
    return sorted(out)


def vectors():
    r = np.random.default_rng(4)
    rows = [(i, int(r.integers(0, 4)), (r.standard_normal(24) + (i % 3)).round(2).tolist()) for i in range(400)]
    base = rows[0][2]
    rows += [(1000 + i, 1, base) for i in range(60)] + [(2000 + i, 2, [x * 0.75 for x in base]) for i in range(40)]
    rows += [(50, 3, base), rows[100], rows[100], (3001, 1, [0.0] * 24), (3050, 1, [0.0] * 24), (4000, 1, [1.0, 2.0]), (4050, 1, [2.0, 2.0]),
             (4001, 2, [1.0, 1.9]), (5000, None, base), (None, 1, base), (5001, 1, None), (5002, 1, []), (5003, 1, [None] * 24),
             (5004, 1, [float("nan")] * 24), (5005, 1, [float("inf")] * 24), (5050, 2, [-x for x in base])]
    return rows


@pytest.mark.parametrize("block", [1 << 19, 700])
def test_hard_negatives(spark, block):
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns(
        {c: F.lit("clash") for c in ("id", "row", "vector", "asked", "score", "place", "dim", "across")})
    got = hn.hard_negatives(table, F.col("vec_id") % 50 == 0, block=block)
    assert sorted(map(tuple, got.collect())) == mined_brute(rows, lambda i: i % 50 == 0)


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<double>")
    assert hn.hard_negatives(none, F.col("vec_id") % 50 == 0).count() == 0


def test_great_integers(spark):
    rows = [(0, 1, [3e6, 1.5]), (1, 1, [2.9e6, 7.25]), (2, 2, [2.2e6 + 1 / 256, 3.0]), (3, 2, [2.2e6, 3.0]), (4, 2, [2.8e6, 1e9]), (5, 1, [1e200, 0.0])]
    got = hn.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == mined_brute(rows[:4], lambda i: i == 0)


def test_intervals_hold():
    r = np.random.default_rng(8)
    rows = np.concatenate([r.integers(-300, 300, (500, 70)), np.repeat(r.integers(-9, 9, (1, 70)), 20, axis=0), np.zeros((2, 70), int)])
    code, along, rest, length = hn.encode(rows)
    low, high = hn.intervals(rows[::9], 70, code, along, rest, length)
    exact = rows[::9] @ rows.T
    assert (low <= exact).all() and (exact <= high).all()
    assert ((high - low) < 2.1 * length[::9, None] * length + 1).all()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_registered_columns(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    try:
        for t in ("documents", "pages", "embeddings", "benchmark"):
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    except duckdb.Error:
        pytest.skip("no test data")
    want = connection.execute(registry.ORACLE[name])
    columns = [d[0] for d in want.description]
    got = registry.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
