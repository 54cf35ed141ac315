"""What must not grow with the input: rows of a task, shuffled texts, files of an arriving part, Python batches."""

import glob

from pyspark.sql import functions as F

from plumbline import session
from plumbline.operators import report
from plumbline.plans import streams
from plumbline.sources import archives

FOUND = "scan_id long, ord long, id string, severity string, confidence string, asvs_category string, title string, file string, line int, detail string, remediation string, code_snippet string"


def _findings(spark, number, per_scan=50):
    severities = ["HIGH", "LOW", "INFO"]
    return spark.createDataFrame(
        [(n // per_scan, n % 7, f"f{n % 11}", severities[n % 3], "c", "ACCESS" if n % 2 else "CONFIG", "t", "a.ts", n, f"d{n:05}", "r", None)
         for n in range(number)], FOUND)


def test_tasks_follow_the_size_of_the_table(spark, tmp_path, monkeypatch):
    spark.range(20_000).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    size = sum(len(open(p, "rb").read()) for p in glob.glob(f"{tmp_path}/t/*.parquet"))
    monkeypatch.setattr(session, "SPREAD_BYTES", size // 40)
    spread = session.spread_by_key(rows, "id")
    assert spread.rdd.getNumPartitions() >= 40
    assert spread.agg(F.count("*"), F.sum("id")).first() == (20_000, 20_000 * 19_999 // 2)


def test_texts_of_hot_keys_are_cut_in_groups(spark, monkeypatch):
    found = _findings(spark, 3_000, 1_000).repartition(8)
    plain = report.report_text(found, ["scan_id"], limit=700).orderBy("scan_id").collect()
    monkeypatch.setattr(report, "SALTS", 3)
    seen = []
    monkeypatch.setattr(report, "_first", lambda *a, real=report._first: seen.append(a[1]) or real(*a))
    # One key has few rows, the others many.
    some = found.filter("scan_id < 2 OR ord = 0")
    hot = report.report_text(some, ["scan_id"], limit=700).orderBy("scan_id").collect()
    assert ["scan_id", "__salt"] in seen
    assert hot[:2] == plain[:2] and [r.scan_id for r in hot] == [0, 1, 2]
    assert all(len(r.text) == 700 for r in hot)


def test_request_texts_of_areas_are_not_shuffled(spark):
    found = _findings(spark, 300).withColumns({"req_id": F.lit("q"), "req_title": F.lit("t"), "req_text": F.lit("x")})
    areas = found.select("scan_id", F.col("asvs_category").alias("category")).distinct().filter("scan_id <> 3 OR category = 'ACCESS'").select(
        "scan_id", "category", F.lit("L").alias("label"), F.lit("V").alias("chapter"), F.lit(25).cast("long").alias("findings"))
    texts = report.area_request_text(found, areas, ["scan_id"], page_size=10)
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning(scan_id" in line and line.count("asvs_category") > 0 and "__body" in line for line in plan.splitlines())
    got = texts.collect()
    assert len(got) == (6 * 2 - 1) * 3 and sum(r.findings for r in got) == (6 * 2 - 1) * 25
    assert all(r.text.startswith("ASVS area: L (V)\nFindings in this area: 25\n\n--- Finding ") for r in got)
    joins = [line for line in plan.splitlines() if "Join" in line and "asvs_category" in line]
    assert not joins


def test_a_part_arrives_in_many_files(spark):
    class Given:
        pass

    given = Given()
    given.spark = spark
    rows = spark.range(900).repartition(6).withColumn("at", F.col("id") * 10)
    seen = {}

    def make_step(store):
        def step(batch, number):
            seen[number] = batch.agg(F.min("at"), F.max("at"), F.count("*")).first()
        return step

    def folders():
        return set(glob.glob(f"{session.staging_folder(spark)}/arriving-*"))

    before = folders()

    streams.replay(given, rows, "at", make_step)
    assert sorted(seen) == [0, 1, 2] and sum(s[2] for s in seen.values()) == 900
    assert seen[0][1] < seen[1][0] and seen[1][1] < seen[2][0]
    (folder,) = folders() - before
    assert all(len(glob.glob(f"{folder}/{part}/*.parquet")) > 1 for part in range(3))


def test_archives_are_not_held_by_the_arrow_batch(spark):
    archives.register(spark)
    spark.createDataFrame([("p", b"x")], "project_id string, archive binary").createOrReplaceTempView("packed_ones")
    plan = spark.sql("SELECT f.* FROM packed_ones a, LATERAL expand_archive(a.archive, 1, 1, 1) f")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan
