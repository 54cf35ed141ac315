"""Operators of the llm subpackage against brute force, on small tables with the awkward cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import ann, bpe, html_extract, licenses, pii, secrets
from plumbline.llm.decontaminate import contamination
from plumbline.llm.near_dedup import near_duplicates
from plumbline.llm.substring_dedup import COVER, PERIOD, drop_repeated
from plumbline.llm.toxicity import learn_lexicon, toxicity

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, key string, id string, component string, window string, n int"


def corpus():
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdeéß漢") for _ in range(r.randint(1, 6))) for _ in range(120)]
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 160))) for _ in range(30)]
    rows = [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (None, base[0])]
    for i in range(150):
        words = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 3, 10])):
            words[r.randrange(len(words))] = r.choice(vocab)
        rows.append((10 + i, " ".join(words)))
    rows += [rows[20], rows[20], (12, "same id, another text"), (400, base[3] * 200)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", "w", 1) for r in corpus()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_contamination(spark, docs, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = [t for _, t in corpus() if t]
    items = [(1, " ".join(word.findall(texts[9])[:14])), (2, texts[12]), (2, texts[12]), (3, "one"), (4, None), (5, ""), (None, texts[15]),
             (6, " ".join(word.findall(texts[20])[:3]))]
    table = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, key string")
    found, spans = contamination(docs, table)
    windows = {}
    for item, text in items:
        w = word.findall((text or "").translate(LOW))
        for k in ([tuple(w[i:i + 10]) for i in range(len(w) - 9)] if len(w) >= 10 else [tuple(w)] if w else []):
            windows.setdefault(k, set()).add(item)
    want = []
    for doc, text in corpus():
        w, hit, seen = word.findall((text or "").translate(LOW)), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    seen |= windows[tuple(w[i:i + n])]
        want.append((doc, len(w), len(hit), sorted(str(i) for i in seen if i is not None)))
    got = [(r["id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert spans.count() > 0
    assert contamination(empty, table)[0].count() == 0
    assert contamination(docs, table.limit(0))[0].where("n_hit > 0").count() == 0


def test_near_duplicates(docs, empty):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for doc, text in corpus():
        w = word.findall((text or "").translate(LOW))
        sets.setdefault(doc, []).append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = {d: d for d in sets if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if a < b and any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    got = near_duplicates(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        assert r["component"] == (None if r["id"] is None else top(r["id"]))
        assert r["n"] in [len(s) for s in sets[r["id"]]]
    assert near_duplicates(empty).count() == 0


def test_cover():
    assert len({int(x) for x in ((COVER[:, None] - COVER[None, :]) % PERIOD).ravel()}) == PERIOD


def test_drop_repeated(spark, empty):
    r = random.Random(8)
    noise = lambda n: "".join(r.choice("ab cé漢") for _ in range(n))
    shared, line = noise(180), noise(99)
    rows = [(5, shared + noise(300) + shared), (2, noise(40) + shared[13:140]), (9, line + "x"), (10, line + "y"), (1, None), (3, ""),
            (4, "z" * 700), (6, "z" * 150), (7, noise(50)), (8, shared), (11, shared), (11, shared), (None, shared + "!")]
    got = drop_repeated(spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, key string")).collect()
    seen, want = set(), {}
    for doc, text in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        raw = (text or "").encode()
        gone = set()
        for i in range(len(raw) - 99):
            gone |= set(range(i, i + 100)) if raw[i:i + 100] in seen else set()
            seen.add(raw[i:i + 100])
        kept = bytes(b for i, b in enumerate(raw) if i not in gone)
        want[doc] = (len(raw), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest(), kept)
    assert len(got) == len(rows)
    for x in got:
        assert (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"], bytes(x["kept"])) == want[x["id"]]
    assert drop_repeated(empty).count() == 0


def test_nearest(spark):
    random_ = np.random.default_rng(2)
    vectors = random_.normal(size=(900, 16)).astype(np.float32)
    vectors[100:400] = vectors[0]
    rows = [(i, v.tolist(), "c") for i, v in enumerate(vectors)]
    rows += [(2000, None, "c"), (2050, [0.0] * 16, "c"), (2100, [float("nan")] * 16, "c"), (2150, [None] * 16, "c"), (None, [1.0] * 16, "c"),
             (50, vectors[50].tolist(), "c"), (2200, [1.0, 2.0], "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string")
    got = {}
    for r in ann.nearest(table, table.where("vec_id % 50 = 0"), shard_size=300).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    hits = total = 0
    for q in range(0, 900, 50):
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(900), -s.round(12)))[:5]
        assert len(got[q]) == 5 and q not in [v for v, _ in got[q]]
        assert all(abs(s[v] - x) < 1e-9 for v, x in got[q])
        hits += len(set(best.tolist()) & {v for v, _ in got[q]})
        total += 5
    assert hits / total >= 0.9
    assert set(got) <= set(range(0, 900, 50))
    assert ann.nearest(table.limit(0), table.limit(0)).count() == 0


def test_pseudonymise(spark, empty):
    rows = [(1, "Mr John Smith wrote JOHN@Acme.com; john@acme.com, +1 (555) 234-5678 or 555-234-5678."), (2, None), (3, ""), (4, "nothing"),
            (5, "Госпожа Анна Иванова, 10.0.0.1 and 10.0.0.2, card 4111 1111 1111 1111, 4111111111111111"), (5, "Госпожа Анна Иванова, 10.0.0.1 and 10.0.0.2, card 4111 1111 1111 1111, 4111111111111111"),
            *[(100 + i, f"ip 10.1.{i // 200}.{i % 200}") for i in range(600)]]
    table = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kind string")
    got = pii.pseudonymise(table, key="k").collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["text"] is None and by[3]["text"] == "" and by[4]["text"] == "nothing"
    m = re.fullmatch(r"Mr (\w+ \w+) wrote (\S+@\S+\.com); (\S+@\S+\.com), \+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3}-\d{3}-\d{4})\.", by[1]["text"])
    assert m and m[2].lower() == m[3] and m[7] == f"{m[4]}-{m[5]}-{m[6]}" and "Smith" not in m[1]
    n = re.fullmatch(r"Госпожа ([А-Яа-я]+ [А-Яа-я]+), (\S+) and (\S+), card (\d{4} \d{4} \d{4} \d{4}), (\d{16})", by[5]["text"])
    assert n and n[2] != n[3] and n[4].replace(" ", "") == n[5]
    assert sum(sum(divmod(int(d) * 2, 10)) if i % 2 == 0 else int(d) for i, d in enumerate(n[5])) % 10 == 0
    ips = [by[100 + i]["text"] for i in range(600)]
    assert len(set(ips)) == 600 and not set(ips) & {t for _, t in rows}
    assert pii.pseudonymise(empty, key="k").count() == 0


def test_bpe(spark, docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    tokens = bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    want = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    extra = ["a" * 3000, " \n " * 200, "漢字" * 300, "don't 12345 <|endoftext|>", "  x", "é" * 130]
    table = docs.select("doc_id", "text", "key").union(spark.createDataFrame([(900 + i, t, "k") for i, t in enumerate(extra)], "doc_id long, text string, key string"))
    encoded = bpe.encode(table, tokens, public.PATTERN)
    texts = {**dict(enumerate(extra, 900))}
    for r in encoded.where("doc_id >= 900").collect():
        assert r["ids"] == want.encode_ordinary(texts[r["doc_id"]])
    lost = encoded.withColumn("n", F.size("ids"))
    back = bpe.decode(lost, tokens).select("doc_id", F.col("decoded").cast("string").alias("text"))
    assert sorted(map(str, back.collect())) == sorted(map(str, table.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()))
    for r in bpe.digests(table, tokens, public.PATTERN).where("id >= 900").collect():
        ids = want.encode_ordinary(texts[r["id"]])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["id"]].encode()).hexdigest()
    assert bpe.digests(empty, tokens, public.PATTERN).count() == 0


def test_secrets(spark, empty, tmp_path):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    texts = [None, "", "TOKEN: 'abcdefgh1' tail", "token=secret:abcdefghij", "é漢 api_key=\"A1b2C3d4E5\" AKIA" + "A" * 12, "0" * 31 + " " + "f" * 40,
             "secret=token=abcdefgh", "AKIAAKIAAKIAAKIA", "x" * 5000 + "passwd = 12345678"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(99, texts[4]), (99, texts[4])]
    table = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, blob string")
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    got = secrets.spans_of(table, ledger).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r["text"] or ""
        want = [(m.start(), "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        want += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        want += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        assert [(s["start"], s["kind"], s["end"]) for s in r["found"]] == sorted(want)
    scanned = ledger.scanned().count()
    assert scanned == len({t or "" for t in texts})
    more = table.union(spark.createDataFrame([(7, "token=ABCDEFGHIJ", "k")], table.schema))
    assert secrets.spans_of(more, ledger).where("size(found) > 0").count() == sum(bool(r["found"]) for r in got) + 1
    assert ledger.scanned().count() == scanned + 1
    masked = secrets.spans_of(table, ledger).select("doc_id", secrets.redact(F.col("text"), F.col("found"), "[x]").alias("t")).collect()
    assert {r["t"] for r in masked if r["doc_id"] == 99} == {"é漢 [x]\" [x]"}
    assert secrets.spans_of(empty, ledger).count() == 0


def test_toxicity(spark, empty):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(30)]
        if i % 4 == 0:
            words[5:5] = r.choice([["you", "fool!!"], ["f00l***", "you"]]) if i % 8 else ["fool", "rotten"]
        rows.append((i, " ".join(words), "l"))
        labels.append((i, int(i % 4 == 0), 1))
    rows += [(1000, None, "l"), (1001, "", "l"), (None, "fool you", "l"), (4, rows[4][1], "l")]
    table = spark.createDataFrame(rows, "doc_id long, text string, label string")
    marks = spark.createDataFrame(labels + [(0, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = toxicity(table, marks.where("doc_id % 5 <> 0 OR doc_id IS NULL"), trees=8).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got)
    held = [(x["score"] >= 0.5) == (x["id"] % 4 == 0) for x in got if x["id"] is not None and x["id"] < 600 and x["id"] % 5 == 0]
    assert sum(held) / len(held) > 0.95
    assert toxicity(empty, marks).count() == 0
    assert {x["score"] for x in toxicity(table, marks.limit(0)).collect()} == {0.0}


def test_toxicity_of_copies(spark):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    insults = ["fool", "rotten", "stupid", "moron", "idiot"]
    rows = []
    for i in range(600):
        words = [word(4) for _ in range(30)]
        if i % 4 == 0:
            words[5:5] = [r.choice(insults)]
        rows.append((i, " ".join(words)))
    # One toxic text of 200 words of its own, with many labelled copies.
    copied = [word(9) for _ in range(200)]
    rows += [(1000 + i, " ".join(copied)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0 or i >= 1000)) for i, _ in rows if i % 5 or i >= 1000], "doc_id long, toxic int")
    learned = [w for w, _ in learn_lexicon(table.selectExpr("doc_id AS id", "text"), labels.selectExpr("doc_id AS id", "toxic AS label"))]
    assert set(insults) <= set(learned) and not set(copied) & set(learned)
    got = toxicity(table, labels, trees=8).collect()
    held = [(x["score"] >= 0.5) == (x["id"] % 4 == 0) for x in got if x["id"] < 600 and x["id"] % 5 == 0]
    assert len(got) == len(rows) and sum(held) / len(held) > 0.95


def test_extract(spark):
    pages = [(1, None), (2, ""), (3, "<p>"), (4, html_extract.labelled_page(77777)[0]), (4, html_extract.labelled_page(77777)[0]),
             (5, '<html><body><nav><ul><li><a href="/x">Home</a></li></ul></nav><article><h1>A title of it</h1><p>First &amp; foremost  a long sentence.\n'
                 "<p>Second paragraph, also long.</article><div class=\"comments\"><h3>Comments</h3><div class=\"comment\"><p>I like it.</p></div></div><footer>&copy; me</footer>")]
    table = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, html string, text string")
    got = html_extract.extract(table).collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == by[3] == ""
    assert by[5] == "A title of it\n\nFirst & foremost a long sentence.\n\nSecond paragraph, also long."
    model = html_extract.train(200)
    wrong = total = 0
    for seed in range(50_000, 50_100):
        page, labels = html_extract.labelled_page(seed)
        blocks = html_extract.leaf_blocks(page)
        assert len(blocks) == len(labels)
        if blocks:
            wrong += sum(a != b for a, b in zip(model.viterbi(html_extract.features(blocks)), labels))
            total += len(labels)
    assert wrong / total < 0.03


def test_skipped_elements():
    def texts(page):
        return [b[0] for b in html_extract.leaf_blocks(page)]

    for tag in ('<svg width="1" a="x>y"/>', "<SVG/>", '<object data="x>y">', "<noscript>", "<template>", "<iframe src=x>", "<object-view>", "<template-card>",
                "<svg-icon a=1>", "<svg/><svg><text>no</text></svg>", "<object>" * 3):
        assert texts(f"<p>One</p>{tag}<p>Two</p>") == ["One", "Two"], tag
        assert texts(f"<p>One</p>{tag}<p>Two</p><svg><p>no</p></svg><p>Three</p>") == ["One", "Two", "Three"], tag
    for name in ("svg", "object", "noscript", "template", "iframe", "script", "style", "title"):
        assert texts(f"<p>One</p><{name} a='b'>no<p>no</p></{name} ><p>Two</p>") == ["One", "Two"]
    assert texts("<object><p>no</p><object>no</object>no</object><p>Two</p>") == ["Two"]
    assert texts("<object><p>One</p><object>no</object><p>Two</p>") == ["One", "Two"]
    assert [texts(f"<p>One</p><{name}>no<p>no</p>") for name in ("script", "style", "title")] == [["One"]] * 3
    assert html_extract.features([("x " * 300 + "All rights reserved, privacy.", 0.0, (), "p")])[0][-2:] == ["rights", "notice"]


def test_licences(spark, empty):
    rows = [(1, None), (2, ""), (3, "Hello there. released under the MIT  licence! Released under the MIT License.\nbye"),
            (4, "\n".join(licenses.SENTENCES[k] + "." for k in ("gpl-free", "gpl-hope", "gpl-details")) + "\nLicensed under CC BY-NC 4.0."),
            (4, "Licensed under CC BY-NC 4.0."), (5, licenses.SENTENCES["mpl2-notice"] + ".")]
    got = licenses.licences(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, licences string")).collect()
    found = sorted((r["doc_id"], list(r["licences"])) for r in got)
    assert found == [(1, []), (2, []), (3, ["MIT"]), (4, ["CC-BY-NC-4.0"]), (4, ["GPL-3.0-or-later", "CC-BY-NC-4.0"]), (5, ["MPL-2.0"])]
    assert licenses.licences(empty).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def test_wrapped_licences(spark):
    headers = {"Apache-2.0": APACHE, "MIT": MIT, "GPL-3.0-or-later": GPL, "BSD": BSD, "ISC": ISC, "MPL-2.0": MPL}
    rows = []
    for name, text in headers.items():
        rows += [(name, text), (name, text.replace("\n", "\r\n")), (name, "/*\n" + "\n".join(f" * {x}" for x in text.split("\n")) + "\n */\nint x;"),
                 *((name, "\n".join(f"{sign} {x}".rstrip() for x in text.split("\n"))) for sign in ("#", "//", "--", ";;", "dnl", "REM"))]
    # Other versions, sentences over a blank line, and words before or behind are not known.
    rows += [("", MPL.replace("v. 2.0", "v. 1.1")), ("", MPL.replace("v. 2.0", "v. 2.1")), ("", ISC.replace("any\n", "any\n\n")), ("", f"No {ISC}"),
             ("", "Licensed under the MIT License and more"), ("", "Licensed under the\nMIT. License"), ("", "Licensed. Under the MIT License")]
    # A notice without a full stop ends at its line; copyright lines stand right before a sentence.
    rows += [("MIT", "Licensed under the MIT License\nCopyright me"), ("MIT,CC0-1.0", "Licensed under the\nMIT License\nLicensed under CC0 1.0\n"),
             ("Apache-2.0", "Copyright 2020 me\nLicensed under the Apache License, Version 2.0\n")]
    found = licenses.licences(spark.createDataFrame(rows, "want string, text string")).selectExpr("want", "array_join(licences, ',') AS got").collect()
    assert len(found) == len(rows) and [r["got"] for r in found] == [r["want"] for r in found]
    whole = licenses.licences(spark.createDataFrame([(APACHE,)], "text string")).first()
    assert whole["sentence_ids"] == ["apache-notice-the", "apache-obtain", "apache-asis", "apache-language"]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert 0 < docs.count() <= before.count()
        if number < 4:
            assert docs.columns == before.columns
    assert {"doc_id", "n_tokens"} <= set(docs.columns)
    assert isinstance(docs.schema["doc_id"].dataType, T.LongType)


def test_small_sets_at_the_threshold_are_linked(spark):
    """Texts of eight words and their first seven, all four shingles in one band of registers: no band is shared."""
    from plumbline.llm import near_dedup as nd
    from plumbline.llm.frames import text_buffers
    from plumbline.llm.words import Words, mix

    import pyarrow as pa

    assert list(nd.small_sizes(75)) == [4, 5, 6]
    r = np.random.default_rng(3)
    texts = [" ".join(map(str, x)) for x in r.integers(0, 10**6, (500_000, 8))]
    data, offsets = text_buffers(pa.array(texts))
    sets = np.array(nd.shingle_sets(Words(data, offsets, nd.WORD), 5))
    band = (mix(sets) % np.uint64(nd.REGISTERS)) // np.uint64(4)
    alone = np.flatnonzero((band == band[:, :1]).all(axis=1) & (len(texts) > 0))
    assert len(alone) >= 1
    rows = [(2 * n + 1, texts[i]) for n, i in enumerate(alone)] + [(2 * n + 2, texts[i].rsplit(" ", 1)[0]) for n, i in enumerate(alone)]
    # One more pair each of five and four, six and five shingles, a chain, and neighbours that only look alike.
    rows += [(101, "a b c d e f g h i"), (102, "b c d e f g h i"), (103, "k l m n o p q r s t"), (104, "l m n o p q r s t"),
             (105, "c d e f g h i"), (106, "u a b c d e f g"), (107, "k l m n o p q r s z")]
    got = {x["id"]: x["component"] for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n in range(len(alone)):
        assert got[2 * n + 2] == 2 * n + 1
    # 107 and 103 share five of seven shingles, 106 and 101 three of six.
    assert [got[n] for n in range(101, 108)] == [101, 101, 103, 103, 101, 106, 107]


def test_copies_over_many_salts_are_one_class(spark):
    copies = [(i, "one text that very many pages carry word for word in full") for i in range(1000, 1400)]
    rows = [*copies, (7, copies[0][1] + " again"), (8, "a text of its own that shares nothing with any of the others")]
    got = {x["id"]: x["component"] for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 8 if i == 8 else 7 for i, _ in rows}


def test_nearest_ties_go_to_the_smaller_id(spark):
    """Twenty multiples of the query by powers of two: different vectors with exactly equal cosines."""
    base = np.random.default_rng(1).normal(size=16).astype(np.float32)
    rows = [(0, base.tolist())] + [(i, (base * np.float32(2.0) ** (i - 10)).tolist()) for i in range(1, 21)]
    rows += [(100 + i, v.tolist()) for i, v in enumerate(np.random.default_rng(5).normal(size=(300, 16)).astype(np.float32))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(table, table.where("vec_id = 0")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5]


def test_surrogates_never_run_out(spark):
    """400 of the 676 addresses of one shape, and far more surnames than short surrogates of a gender."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{letters[i // 26]}@{letters[i % 26]}.com" for i in range(400)]
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(mails)), "doc_id long, text string"), key="k").collect()
    new = {r["text"] for r in got}
    assert len(got) == 400 and len(new) == 400 and not new & set(mails)
    assert all(re.fullmatch(r"[a-z]+@[a-z]\.com", t) for t in new)
    pool = spark.range(300_000).select(F.concat(F.lit("Mr "), F.initcap(F.translate(F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "abcdefghij"))).alias("text"), F.col("id").alias("doc_id"))
    names = pii.pseudonymise(pool, key="k")
    assert names.select("text").distinct().count() == 300_000


def test_names_keep_script_and_reference(spark):
    texts = ["Mr John Smith met Mr Smith; John Smith left. Ms John Smith and Johnny Smith stay.", "Κύριος Γιώργος Παπαδόπουλος, Κυρία Παπαδοπούλου",
             "السيد محمد علي", "Mr 王小明", "Mrs Smith", "Господин Иванов, Госпожа Иванова"]
    rows = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="k").collect()}
    m = re.fullmatch(r"Mr (\w+) (\w+) met Mr (\w+); (\w+) (\w+) left\. Ms (\w+) (\w+) and Johnny Smith stay\.", rows[0]["text"])
    assert m and m[1] == m[4] and m[2] == m[3] == m[5] == m[7] and m[1] != m[6] and not {"John", "Smith"} & set(m.groups())
    assert rows[4]["text"] == f"Mrs {m[2]}"
    assert re.fullmatch("Κύριος [Α-Ωα-ως]+ [Α-Ωα-ως]+, Κυρία [Α-Ωα-ως]+", rows[1]["text"]) and "Γιώργος" not in rows[1]["text"]
    assert re.fullmatch("السيد [ء-ي]+ [ء-ي]+", rows[2]["text"]) and "محمد" not in rows[2]["text"]
    assert re.fullmatch("Mr [一-鿿]{3}", rows[3]["text"]) and "王小明" not in rows[3]["text"]
    assert re.fullmatch("Господин [А-Я][а-я]+, Госпожа [А-Я][а-я]+(?:а|ая)", rows[5]["text"])
    assert rows[0]["n_entities"] == 4 and rows[0]["n_distinct"] == 3
