"""Working trees, archives, sinks."""

import gzip
import json
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from plumbline.operators.scan import admit_files, scan_projects
from plumbline.sources import sinks
from plumbline.sources.archives import expand_archives, failed_archives, repo_path, unpack_archives
from plumbline.sources.tree import read_tree


def test_read_tree_of_any_bytes_and_size(spark, tmp_path):
    (tmp_path / "db").mkdir()
    (tmp_path / "db" / "big.sql").write_text("create table t (id int);\n" + "-- filler\n" * 150_000)
    (tmp_path / "latin.ts").write_bytes("const a = 'é';\n".encode("latin-1"))
    (tmp_path / "logo.png").write_bytes(bytes(range(256)))
    for root in (str(tmp_path), f"file://{tmp_path}"):
        rows = {r["path"]: r["content"] for r in read_tree(spark, root).collect()}
        assert set(rows) == {"db/big.sql", "latin.ts", "logo.png"}
        assert rows["latin.ts"] == "const a = '\ufffd';\n" and len(rows["db/big.sql"]) > 1_000_000
    capped = admit_files(read_tree(spark, str(tmp_path)), max_files=1, max_bytes=10_000_000).collect()
    assert [(r["path"], r["truncated"]) for r in capped] == [("db/big.sql", True)]


def test_read_tree(spark, tmp_path):
    files = {"b.ts": "eval(x)", "a/z.ts": "é", "a.ts": "x", "node_modules/q.ts": "eval(x)", "a b+c%20.sql": "select 1"}
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "big.ts").write_text("x" * 1_000_001)
    rows = read_tree(spark, str(tmp_path), max_bytes=1_000_000).orderBy("file_seq").collect()
    assert [(r.path, r.content) for r in rows] == [
        ("a/z.ts", "é"), ("a b+c%20.sql", "select 1"), ("a.ts", "x"), ("b.ts", "eval(x)")
    ]
    found = scan_projects(read_tree(spark, str(tmp_path))).collect()
    assert [(f.rule, f.file, f.line) for f in found] == [("G", "b.ts", 1)]
    (tmp_path / "notes.md").write_text("x")
    only = read_tree(spark, str(tmp_path), max_bytes=1_000_000, scannable_only=True).collect()
    assert sorted(r.path for r in only) == ["a b+c%20.sql", "a.ts", "a/z.ts", "b.ts"]
    nested = read_tree(spark, str(tmp_path), project_depth=1).filter("project_id = 'a'").collect()
    assert [r.path for r in nested] == ["z.ts"]


def archive(*entries):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as tar:
        for name, text in entries:
            info = tarfile.TarInfo(name)
            if text is None:
                info.type, info.linkname = tarfile.SYMTYPE, "target"
                tar.addfile(info)
            else:
                info.size = len(text)
                tar.addfile(info, io.BytesIO(text.encode()))
    return gzip.compress(buffer.getvalue())


def test_archives(spark):
    whole = archive(("w/b.ts", "1"), ("w/a.sql", "2"), ("w/readme.md", "3"), ("w/link.ts", None), ("w/big.ts", "x" * 100),
                    ("w/dist/c.ts", "4"), ("w/" + "d" * 150 + ".ts", "5"), ("w/z.ts", "6"), ("top.ts", "7"))
    plain = gzip.decompress(whole)
    pax = io.BytesIO()
    with tarfile.open(fileobj=pax, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for name, text in (("w/" + "é" * 120 + ".ts", "p"), ("w/twice.ts", "old"), ("w/x.ts", "\udcff"), ("w/twice.ts", "new"), ("w/y.png", "\udc89PNG")):
            info = tarfile.TarInfo(name)
            data = text.encode("utf-8", "surrogateescape")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    rows = [
        ("p", whole), ("bad", b"not an archive"), ("none", None), ("nothing", b""), ("empty", archive()), ("half", whole[:len(whole) // 2]),
        ("damaged", whole[:-8] + bytes(8)), ("cut", gzip.compress(plain[:plain.index(b"w/z.ts") + 512])), ("two", gzip.compress(plain[:700]) + gzip.compress(plain[700:])),
        ("bomb", gzip.compress(plain + bytes(300_000))), ("pax", gzip.compress(pax.getvalue())), ("text", gzip.compress(b"x" * 600)),
    ]
    archives = spark.createDataFrame(rows, "project_id string, archive binary")
    files, statuses = unpack_archives(archives, max_bytes=50, max_archive=100_000)
    names = ["b.ts", "a.sql", "d" * 150 + ".ts", "z.ts"]
    got = {}
    for r in files.orderBy("file_seq").collect():
        got.setdefault(r.project_id, []).append((r.path, r.content))
    assert {k: [p for p, _ in v] for k, v in got.items() if k != "pax"} == {"p": names, "two": names, "cut": names[:3]}
    assert got["p"] == list(zip(names, "1256"))
    assert got["pax"] == [("é" * 120 + ".ts", "p"), ("twice.ts", "new"), ("x.ts", "\ufffd")]
    assert {r.project_id: r.status for r in statuses.collect()} == {
        "p": "ok", "bad": "not_gzip", "none": "missing", "nothing": "not_gzip", "empty": "ok", "half": "broken", "damaged": "broken", "cut": "ok",
        "two": "ok", "bomb": "too_large", "pax": "ok", "text": "ok"}
    assert sorted(r.project_id for r in failed_archives(statuses).collect()) == ["bad", "bomb", "damaged", "half", "none", "nothing"]
    capped = expand_archives(archives.filter("project_id = 'p'"), max_bytes=50, max_files=2).orderBy("file_seq").collect()
    assert [(r.path, r.truncated) for r in capped] == [("b.ts", True), ("a.sql", True)]
    exact, told = unpack_archives(archives.filter("project_id = 'p'"), max_bytes=50, max_files=4)
    assert exact.count() == 4 and [r.truncated for r in told.collect()] == [False]


def test_archive_paths_are_classified_like_columns(spark):
    from plumbline.functions.paths import is_scannable_path, normalize_path

    names = ["a.ts", "./a.ts", "././a.ts", "a/.ts", "a/b.", "dist/a.ts", "a/dist", "x\\node_modules\\a.js", "A.TS", "a.test.sql", ".env.js", "", "build.ts/x.mjs"]
    rows = spark.createDataFrame([(n,) for n in names], "path string").select(
        "path", F.when(is_scannable_path(F.col("path")), normalize_path(F.col("path"))).alias("want"))
    assert {r.path: r.want for r in rows.collect()} == {n: repo_path("w/" + n) for n in names}


def test_admission_of_a_hot_project(spark):
    files = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("project_id"), F.col("id").alias("file_seq"),
        F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".ts")).alias("path"), F.lit("x").alias("content"),
    )
    got = admit_files(files, max_files=150, bound=50)
    counts = {r.project_id: (r.n, r.last, r.t) for r in got.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("file_seq").alias("last"), F.max("truncated").alias("t")).collect()}
    assert counts == {"cold": (100, 297, False), "hot": (150, 224, True)}


def test_commits_appear_once_or_not_at_all(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    day = lambda n: F.lit("2024-01-02 03:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=n.cast("int"))
    scans = spark.range(200).select(F.col("id").alias("scan_id"), day(F.col("id") % 5).alias("created_at"))
    findings = spark.range(4000).select((F.col("id") % 200).alias("scan_id"), F.col("id").cast("string").alias("id")).repartition(40)
    mark = sinks._mark

    def killed(*_):
        raise RuntimeError("killed")

    sinks.write_scans(scans, findings, out, 0)
    monkeypatch.setattr(sinks, "_mark", killed)
    with pytest.raises(RuntimeError):
        sinks.write_scans(scans, findings, out, 1)
    assert sinks.committed(spark, out, "scan_findings").count() == 4000
    monkeypatch.setattr(sinks, "_mark", mark)
    for _ in range(2):
        sinks.write_scans(scans, findings, out, 1)
    stored = sinks.committed(spark, out, "scan_findings")
    assert stored.count() == 8000 and sinks.committed(spark, out, "scans").count() == 400
    assert stored.groupBy("commit", "scan_date").count().count() == 10
    files = list((tmp_path / "out" / "scan_findings" / "commit=1").glob("scan_date=*/*.parquet"))
    assert len(files) <= 2 * 5  # of 40 tasks that each hold all five dates


def test_console_text(spark, tmp_path):
    pages = spark.range(300).select(
        F.concat(F.lit("p"), (F.col("id") % 100).cast("string")).alias("project_id"), F.floor(F.col("id") / 100).alias("page"),
        F.lit("head").alias("head"), F.col("id").cast("string").alias("body"), F.lit("end").alias("summary"))
    sinks.write_console(pages, str(tmp_path), "a", buckets=4)
    sinks.write_console(pages, str(tmp_path), "a", buckets=4)
    got = sinks.console_page(spark, str(tmp_path), "p7", buckets=4).orderBy("page").collect()
    assert [(r["page"], r["value"]) for r in got] == [(n, f"head\n\n{7 + 100 * n}\n\nend") for n in range(3)]
    assert len(list((tmp_path / "console" / "commit=a").glob("bucket=*"))) <= 4
    sinks.write_results(pages.select("project_id"), str(tmp_path / "r"), 1)
    assert sinks.committed(spark, str(tmp_path / "r"), "results").count() == 300


def test_sinks(spark, tmp_path):
    docs = spark.sql("select '{\"a\":1}' json")
    sinks.write_documents(docs, str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs")).first()[0] == '{"a":1}'
    parsed = sinks.findings_from_json(
        spark.createDataFrame([('[{"id":"x"}]',), ("{}",), (None,)], "json string"), "struct<id:string>"
    )
    sizes = [len([f for f in r.findings if f.id]) for r in parsed.collect()]
    assert sizes == [1, 0, 0]


def test_controls_from_json(spark, tmp_path):
    from plumbline.operators.controls import control_dims, primary_requirement, requirements_of_category

    document = {
        "version": "9", "source": "s", "note": "n", "categoryMap": {"ACCESS": ["r2", "gone", "r1"], "EMPTY": []},
        "requirements": [
            {"id": i, "chapter": "c", "section": "s", "title": f"title {i}", "text": "t"} for i in ("r1", "r2")
        ],
    }
    (tmp_path / "controls.json").write_text(json.dumps(document, indent=2))
    dims = control_dims(spark, str(tmp_path / "controls.json"))
    rows = spark.createDataFrame([("ACCESS",), ("EMPTY",), ("OTHER",)], "asvs_category string")
    listed = requirements_of_category(rows, dims).orderBy("ord").collect()
    assert [(r.asvs_category, r.ord, r.req_id) for r in listed] == [("ACCESS", 0, "r2"), ("ACCESS", 2, "r1")]
    first = {r.asvs_category: (r.req_id, r.req_title) for r in primary_requirement(rows, dims).collect()}
    assert first == {"ACCESS": ("r2", "title r2"), "EMPTY": ("unknown", "EMPTY"), "OTHER": ("unknown", "OTHER")}
    built_in = control_dims(spark)
    assert (built_in[0].count(), built_in[1].count()) == (9, 9)


def test_event_sources(spark, tmp_path):
    from plumbline.operators.events import scan_requests
    from plumbline.sources import events as src

    payload = {"installation": {"id": 1}, "after": "abc", "ref": "refs/heads/main",
               "repository": {"id": 5, "full_name": "o/r", "default_branch": "main"}}
    lines = [{"seq": n, "event": e, "payload": json.dumps(payload), "ts": "2024-01-01T00:00:00"}
             for n, e in enumerate(["push", "ping"])]
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    installs = spark.createDataFrame([(1, 9, None)], "installation_id bigint, user_id bigint, suspended_at timestamp_ntz")
    assert [r.seq for r in scan_requests(src.read_repo_events(spark, str(tmp_path / "repo")), installs).collect()] == [0]
    assert src.read_repo_events(spark, str(tmp_path / "repo"), stream=True).isStreaming
    (tmp_path / "bill").mkdir()
    (tmp_path / "bill" / "a.json").write_text(json.dumps({"id": "e", "type": "other", "arrival_seq": 1}))
    billing = src.read_billing_events(spark, str(tmp_path / "bill"))
    assert billing.count() == 1 and src.handled_billing_events(billing).count() == 0
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.json").write_text('{"findings":[]}\n')
    assert src.read_submissions(spark, str(tmp_path / "sub")).first().asDict() == {"source": "x.json", "value": '{"findings":[]}'}


def test_observed_progress(spark):
    from plumbline.operators.report import observe_progress

    found = spark.createDataFrame([("HIGH",), ("LOW",)], "severity string")
    observed, seen = observe_progress(found)
    observed.write.format("noop").mode("overwrite").save()
    assert seen.get == {"findings": 2, "high": 1}


def test_staging_folder_without_a_setting():
    from types import SimpleNamespace

    from plumbline.session import staging_folder

    conf = SimpleNamespace(get=lambda name, default: default)
    local = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]", applicationId="a"))
    assert staging_folder(local) == staging_folder(local)
    remote = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn", applicationId="b"))
    with pytest.raises(ValueError):
        staging_folder(remote)
