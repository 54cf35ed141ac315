"""Each pipeline stage against a brute-force version, on planted rows with shared ids, nulls and clashing names."""

import hashlib
import random
import re

import pytest

import corpus_pipeline as cp

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, n_chars long, found string, _blob string, _key string, _row string, ids string, _spans string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def planted():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    text = lambda n=40: " ".join(r.choice(vocab) for _ in range(n))
    passage, base = text(14), [text(60) for _ in range(6)]
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10, base[0]), (10, base[0]), (11, near(base[1])), (12, text() + " " + passage + " " + text()), (13, None), (14, ""), (15, "few words"),
             (1, text(30)), (None, near(base[2])), (None, text(25)), (None, None), (16, "token = abcdefgh1234 " + text()), (17, text(3000)),
             (18, "one two three four five six seven eight"), (19, "one two three four five six seven"), (0, base[0])]
    return rows, [(1, passage), (2, "few words"), (3, None), (4, "")]


@pytest.fixture(scope="module")
def docs(spark, planted):
    return spark.createDataFrame([(i, t, len(t or ""), *"fbkris"[:6]) for i, t in planted[0]], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, planted, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(planted[1], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def untouched(before, after):
    assert after.columns == before.columns
    assert {tuple(r)[3:] for r in after.collect()} == {tuple(r)[3:] for r in before.collect()}


def test_near_duplicates_by_row(spark, docs, planted, folder):
    rows = planted[0]
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = []
    for g in set(group):
        want.append(min((rows[i] for i in range(len(rows)) if group[i] == g), key=lambda x: (x[0] is None, x[0])))
    got = cp.drop_near_duplicates(spark, docs, folder)
    # Near copies without an id may tie; everything else is decided.
    assert rows_of(got) == sorted(want, key=str)
    untouched(docs, got)
    assert cp.drop_near_duplicates(spark, docs.limit(0), folder).count() == 0


def test_contaminated_rows_go(spark, docs, planted, folder):
    rows, items = planted
    windows = set()
    for _, t in items:
        w = WORD.findall((t or "").lower())
        windows |= {tuple(w[i:i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)} if w else set()
    def hit(t):
        w = WORD.findall((t or "").lower())
        return any(tuple(w[i:i + n]) in windows for n in range(1, 11) for i in range(len(w) - n + 1))
    got = cp.drop_contaminated(spark, docs, folder)
    want = [x for x in rows if not hit(x[1])]
    assert len(want) == len(rows) - 2 and rows_of(got) == sorted(want, key=str)
    untouched(docs, got)


def test_secrets_are_masked(spark, docs, planted, folder):
    got = cp.mask_secrets(spark, docs, folder)
    want = [(i, t if t is None else re.sub(r"token = abcdefgh1234", cp.SECRET_MARK, t)) for i, t in planted[0]]
    assert rows_of(got) == sorted(want, key=str)
    assert all(r["n_chars"] == len(r["text"] or "") for r in got.collect())
    untouched(docs, got)


def test_tokens(spark, docs, planted, folder):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    from plumbline.llm import bpe

    tokens = bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    whole = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in cp.encode(spark, docs, folder).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = [(i, whole.encode_ordinary(t or ""), (t or "").encode()) for i, t in planted[0]]
    assert got == sorted(((i, len(n), sha(",".join(map(str, n)).encode()), sha(t)) for i, n, t in ids), key=str)


def test_toxic_documents_go(spark, tmp_path):
    r = random.Random(6)
    rows = []
    for i in range(500):
        words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(30)]
        if i % 5 == 0:
            words[5:5] = ["you", "fool!!", "rotten"]
        rows.append((i, " ".join(words)))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _ in rows if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.createDataFrame(rows + [(None, "you fool"), (900, None), (901, "")], "doc_id long, text string")
    kept = {x["doc_id"] for x in cp.drop_toxic(spark, table, str(tmp_path)).collect()}
    assert kept == {None, 900, 901} | {i for i, _ in rows if i % 5}
