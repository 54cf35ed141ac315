"""Semantic traps of the operators over findings, events, jobs and billing."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from plumbline import fixed_values as fv
from plumbline.functions import keys as k, paths
from plumbline.operators import billing, controls, diff, enrichment as en, events as ev, gate, jobs as jb
from plumbline.operators import posture, report, setups as st, tenancy as tn
from plumbline.sources import submissions as sub

FINDING = (
    "scan_id bigint, ord bigint, id string, severity string, confidence string, asvs_category string, title string, "
    "file string, line int, detail string, remediation string, code_snippet string"
)


def finding(scan, ord_, id_, severity="HIGH", category="SECRETS", file="a.ts", line=1, detail="d", fix="f"):
    return (scan, ord_, id_, severity, "definitive", category, "T", file, line, detail, fix, None)


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 0, minute, second)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_paths(spark):
    cases = [
        (".env", None, False), ("a/b.TS", None, False), ("a/b.ts", "code", True), ("./x.sql", "sql", True),
        ("././x.sql", "sql", True), ("a\\b.mjs", "code", True), ("build", None, False), ("dist/a.ts", "code", False),
        ("a.b/c", None, False), ("a.d.ts", "code", True),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "p string")
    got = df.select(
        "p", paths.classify_file(paths.normalize_path(F.col("p"))).alias("kind"), paths.is_scannable_path(F.col("p")).alias("ok")
    ).collect()
    assert [tuple(r) for r in got] == cases
    one = df.limit(1).select(paths.normalize_path(F.lit("././x")), paths.repo_owner(F.lit("a/b/c")), paths.repo_name(F.lit("a/b/c")),
                             paths.repo_owner(F.lit("/x")), paths.repo_name(F.lit("x"))).first()
    assert tuple(one) == ("./x", "a", "b/c", "/x", "")


def test_diff_keeps_multiplicity(spark):
    scans = spark.createDataFrame(
        [(1, 7, "o/r", False, at(1)), (2, 7, "o/r", True, at(2)), (3, 7, "o/r", False, at(3)), (4, None, "o/r", False, at(4)),
         (5, 7, "o/r", False, at(5))],
        "scan_id bigint, installation_id bigint, repo string, is_pull_request boolean, created_at timestamp_ntz",
    )
    found = spark.createDataFrame(
        [finding(1, 0, "x", detail="old"), finding(1, 1, "x", detail="old2"), finding(1, 2, "gone"),
         finding(3, 0, "x"), finding(3, 1, "n"), finding(3, 2, "n"), finding(5, 0, "n")],
        FINDING,
    )
    history = diff.baseline_history(scans, bound=1)
    assert rows(history, "scan_id", "baseline_scan_id") == [(1, None), (2, 1), (3, 1), (4, None), (5, 3)]
    assert rows(diff.latest_baseline(scans), "installation_id", "repo", "baseline_scan_id") == [(7, "o/r", 5)]
    assert rows(diff.new_findings(found, history).filter("scan_id = 3"), "id") == [("n",), ("n",)]
    carried = diff.carried_findings(found, history)
    assert rows(carried.filter("scan_id = 3"), "id", "detail") == [("x", "old"), ("x", "old2")]
    assert rows(diff.resolved_findings(found, history).filter("scan_id = 3"), "id") == [("gone",)]
    kept = diff.persisted_posture(found, scans, bound=1)
    assert rows(kept.filter("scan_id = 5"), "id", "status") == [("n", "carried")] * 2
    assert diff.compare_sets(found, found.orderBy("id")).count() == 0
    assert diff.compare_sets(found, found.limit(6)).count() == 1


def test_persisted_posture_over_a_history(spark):
    """Rows of an id come from the first scan of its unbroken run; a pull request begins no run."""
    scans = spark.createDataFrame(
        [(1, 7, "o/r", False, at(1)), (2, 7, "o/r", False, at(2)), (3, 7, "o/r", False, at(3)), (4, 7, "o/r", True, at(4)),
         (5, 7, "o/r", False, at(5)), (6, 7, "o/r", False, at(6)), (9, None, "o/r", False, at(7))],
        "scan_id bigint, installation_id bigint, repo string, is_pull_request boolean, created_at timestamp_ntz",
    )
    found = spark.createDataFrame(
        [finding(1, 0, "x", detail="a"), finding(1, 1, "x", detail="b"), finding(1, 2, "y"),
         *[finding(s, 0, "x", detail="c") for s in (2, 3, 4)], finding(3, 1, "y", detail="again"),
         finding(4, 2, "p"), finding(4, 3, "y"), finding(5, 1, "p", detail="main"), finding(6, 0, "x", detail="back"),
         finding(9, 0, "x", detail="alone")],
        FINDING,
    )
    kept = diff.persisted_posture(found, scans, bound=1)
    runs = [(s, i, f"{d}{o}", t) for s, i, d, o, t in rows(kept, "scan_id", "id", "detail", "origin_scan_id", "status")
            if i not in ("p", "y")]
    assert sorted(runs) == sorted(
        [(1, "x", "a1", "new"), (1, "x", "b1", "new")]
        + [(s, "x", f"{d}1", "carried") for s in (2, 3, 4) for d in "ab"]
        + [(6, "x", "back6", "new"), (9, "x", "alone9", "new")]
    )
    assert rows(kept.filter("id = 'p'"), "scan_id", "origin_scan_id", "status") == [(4, 4, "new"), (5, 5, "new")]
    assert rows(kept.filter("id = 'y'"), "scan_id", "origin_scan_id", "status") == [(1, 1, "new"), (3, 3, "new"), (4, 3, "carried")]


@pytest.mark.parametrize(
    "mode,fail_on,want",
    [("enforce", "HIGH", "failure"), ("report-only", "HIGH", "neutral"), ("enforce", "nonsense", "failure")],
)
def test_gate_modes(spark, mode, fail_on, want):
    found = spark.createDataFrame([finding(1, 0, "a"), finding(2, 0, "b", "MEDIUM"), finding(3, 0, "c", "WEIRD")], FINDING)
    universe = spark.createDataFrame([(1,), (2,), (3,), (9,)], "scan_id bigint")
    got = dict(rows(gate.gate(found, ["scan_id"], mode, fail_on, universe), "scan_id", "conclusion"))
    assert got == {1: want, 2: "success", 3: "success", 9: "success"}


def test_gate_is_monotone_and_counts_sum(spark):
    found = spark.createDataFrame([finding(s, 0, "a", sev) for s, sev in enumerate(fv.SEVERITIES)], FINDING)
    blocked = [
        gate.gate(found, ["scan_id"], "enforce", level).filter("would_block").count() for level in fv.SEVERITIES
    ]
    assert blocked == sorted(blocked) == [1, 2, 3, 4]
    counts = gate.severity_counts(found, []).first()
    assert sum(counts) == 4


def test_posture_order_and_label_trap(spark):
    scans = spark.createDataFrame([(1,), (2,)], "scan_id bigint")
    found = spark.createDataFrame(
        [finding(1, 0, "a", "LOW", "CONFIG"), finding(1, 1, "b", "HIGH", "INJECTION"),
         finding(1, 2, "c", "HIGH", fv.CATEGORY_LABEL["ACCESS"])], FINDING)
    areas = posture.area_posture(scans, found)
    assert rows(areas.filter("scan_id = 1"), "position", "category", "level", "summary") == [
        (0, "INJECTION", "vulnerable", "1 high · 1 finding"), (1, "CONFIG", "safer", "0 high · 1 finding"),
        (2, "ACCESS", "safe", "nothing to do"), (3, "SECRETS", "safe", "nothing to do"),
    ]
    assert rows(posture.overall_posture(areas), "scan_id", "level") == [(1, "vulnerable"), (2, "safe")]
    fixed = found.withColumn("asvs_category", k.category_key(F.col("asvs_category")))
    assert rows(posture.area_posture(scans, fixed).filter("scan_id = 1 AND category = 'ACCESS'"), "level") == [("vulnerable",)]


def test_report_text_and_annotations(spark):
    found = spark.createDataFrame(
        [finding(1, 0, "a", "LOW"), finding(1, 1, "b", "HIGH", fix="", line=None), finding(1, 2, "c", "HIGH", file="(project)")],
        FINDING,
    )
    universe = spark.createDataFrame([(1,), (2,)], "scan_id bigint")
    out = {r.scan_id: r for r in report.render_report(found, ["scan_id"], "enforce", universe=universe).collect()}
    assert out[1].text == (
        "### [HIGH] T\n`a.ts`  ·  definitive\n\nd\n\n\n---\n\n### [HIGH] T\n`(project):1`  ·  definitive\n\nd\n\n**Fix:** f"
        "\n\n---\n\n### [LOW] T\n`a.ts:1`  ·  definitive\n\nd\n\n**Fix:** f"
    )
    assert out[2].text == "No findings." and out[2].title == "0 high · 0 medium · 0 low"
    assert "Gate **failed**" in out[1].summary and "Gate **passed**" in out[2].summary
    marks = report.annotations(found, ["scan_id"], batch=1)
    assert rows(marks, "batch", "start_line", "annotation_level", "message") == [
        (0, 1, "notice", "d\n\nFix: f"), (1, 1, "failure", "d")
    ]


def test_report_cut_is_exact(spark):
    many = spark.range(5000).select(
        F.lit(1).cast("long").alias("scan_id"), F.col("id").alias("ord"), F.concat(F.lit("i"), "id").alias("id"),
        F.lit("HIGH").alias("severity"), F.lit("definitive").alias("confidence"), F.lit("SECRETS").alias("asvs_category"),
        F.lit("").alias("title"), F.lit("").alias("file"), F.lit(None).cast("int").alias("line"), F.lit("").alias("detail"),
        F.lit("").alias("remediation"), F.lit(None).cast("string").alias("code_snippet"),
    )
    one = "### [HIGH] \n``  ·  definitive\n\n\n"
    assert report.report_text(many, ["scan_id"]).first().text == "\n\n---\n\n".join([one] * 5000)[:60000]
    more = spark.range(12_000).select(
        (F.col("id") % 2).alias("scan_id"), F.floor(F.col("id") / 2).alias("ord"), F.lit("i").alias("id"), F.lit("HIGH").alias("severity"), F.lit("").alias("detail"))
    # Renderings of one character, of none, and of very different lengths.
    shapes = {
        "one": (F.lit("x"), lambda n: "x"), "none": (F.lit(None).cast("string"), lambda n: ""),
        "mixed": (F.expr("repeat('y', cast(ord % 50 * (ord % 3) as int))"), lambda n: "y" * (n % 50 * (n % 3))),
    }
    for rendered, plain in shapes.values():
        for limit in (60_000, 100, 7, 1):
            want = "\n\n---\n\n".join(plain(n) for n in range(6000))[:limit]
            got = report.report_text(more, ["scan_id"], rendered, limit).collect()
            assert [r.text for r in got] == [want, want]


def test_documents_in_pages(spark):
    found = spark.createDataFrame([finding(1, n, f"i{n}") for n in range(5)], FINDING).withColumn("project_id", F.lit("p"))
    scanned = spark.createDataFrame([("p", 3, 2, 1), ("q", 1, 1, 0)], "project_id string, files bigint, code bigint, sql bigint")
    pages = {(r.project_id, r.page): json.loads(r.json) for r in report.report_documents(found, scanned, page_size=2).collect()}
    assert sorted(pages) == [("p", 0), ("p", 1), ("p", 2), ("q", 0)]
    assert [len(pages["p", n]["findings"]) for n in range(3)] == [2, 2, 1]
    assert pages["p", 0]["counts"] == {"HIGH": 5, "MEDIUM": 0, "LOW": 0, "INFO": 0}
    assert pages["p", 0]["findings"][0]["asvs"] == fv.CATEGORY_LABEL["SECRETS"] and pages["q", 0]["findings"] == []


def test_cache_and_merge(spark):
    found = spark.createDataFrame([finding(1, 0, "a"), finding(1, 1, "a"), finding(1, 2, "b", category="NONE")], FINDING)
    dims = controls.control_dims(spark)
    empty = spark.createDataFrame([], en.CACHE_SCHEMA)
    calls = spark.sparkContext.accumulator(0)

    def enricher(batches):
        for pdf in batches:
            calls.add(len(pdf))
            out = pdf[["scan_id", "id", "ord"]].copy()
            out["likely"], out["explanation"] = "low", "model " + out["ord"].astype(str)
            out["steps"], out["example"] = [["s"]] * len(out), None
            yield out[out["id"] == "a"]

    first = en.enrich(found, empty, "m1", dims, enricher)
    first.count()
    assert rows(first, "id", "explanation", "req_id", "likely", "answered") == [
        ("a", "model 1", "v5.0.0-14.1.1", "low", True), ("a", "model 1", "v5.0.0-14.1.1", "low", True),
        ("b", "d", "unknown", "high", False),
    ]
    assert calls.value == 3
    cache = en.cache_upsert(empty, first.filter("answered"), "m1", "2024-01-01 00:00:00")
    assert cache.count() == 1
    assert en.uncached(found, cache, "m1").count() == 1 and en.uncached(found, cache, "m2").count() == 3
    hits = en.cache_hits(en.cache_lookup(found, cache, "m1"), "scan_id")
    again = en.cache_upsert(cache, first.filter("answered"), "m2", "2024-02-01 00:00:00", hits)
    assert rows(again, "model", "hit_count") == [("m2", 1)]
    key = found.select(k.cache_key(F.lit("a"), F.lit(None).cast("string"), F.lit("bc"))).first()[0]
    assert key != found.select(k.cache_key(F.lit("ab"), F.lit(None).cast("string"), F.lit("c"))).first()[0]


REQUEST = (
    "seq bigint, ts timestamp_ntz, installation_id bigint, repo_full_name string, repo_id bigint, head_sha string, "
    "ref string, is_pull_request boolean, user_id bigint"
)


def request(seq, sha, ref="main", pr=False):
    return (seq, at(0, seq), 1, "o/r", 5, sha, ref, pr, 9)


def test_supersede_and_redelivery(spark):
    arrivals = spark.createDataFrame(
        [request(1, "a"), request(2, "b"), request(3, "b"), request(4, "c", "x", True), request(5, "a"), request(6, "c")], REQUEST
    )
    got = jb.supersede(arrivals, bound=2)
    # The late delivery of "a" closes "b" and queues nothing; "c" was first seen as a pull request.
    assert rows(got, "head_sha", "status", "closed_by_seq") == [("a", "done", 2), ("b", "done", 5), ("c", "queued", None)]
    assert rows(jb.superseded_counts(got), "closed_by_seq", "closed") == [(2, 1), (5, 1)]
    claims = spark.createDataFrame([(5, "b", 4)], "repo_id bigint, head_sha string, claim_seq bigint")
    assert rows(jb.supersede(arrivals, claims, bound=2).filter("head_sha = 'b'"), "status") == [("queued",)]
    once = jb.supersede(arrivals, ignore_redelivery=True, bound=2)
    assert rows(once, "head_sha", "closed_by_seq") == [("a", 2), ("b", None), ("c", None)]


def test_job_state_and_backlog(spark):
    log = [("j1", "queued")] + [("j1", e) for _ in range(5) for e in ("claimed", "failed")]
    log += [("j2", "queued"), ("j2", "claimed"), ("j2", "check_opened"), ("j2", "failed")]
    log += [("j3", "queued")] + [("j3", "claimed")] * 5
    log += [("j4", "queued"), ("j4", "claimed"), ("j4", "failed"), ("j4", "claimed"), ("j4", "check_opened"), ("j4", "done")]
    data = [(j, 1, e, n, at(0, n), f"e{n}", n) for n, (j, e) in enumerate(log)]
    events = spark.createDataFrame(
        data, "job_id string, installation_id bigint, event string, seq bigint, ts timestamp_ntz, error string, check_run_id bigint"
    )
    jobs = jb.job_state(events)
    assert rows(jobs, "job_id", "status", "attempts") == [
        ("j1", "dead", 5), ("j2", "error", 1), ("j3", "running", 5), ("j4", "done", 2)
    ]
    assert rows(jobs.filter("job_id = 'j4'"), "last_error", "check_run_id") == [(None, 25)]
    claimed = rows(jobs.filter("job_id = 'j2'"), "claimed_at")[0][0]
    just = lambda s: (claimed + dt.timedelta(seconds=s)).isoformat(" ")
    # One attempt waits 60 s, not 30 s.
    assert rows(jb.backlog(jobs, just(60)).filter("job_id = 'j2'"), "reason") == []
    assert rows(jb.backlog(jobs, just(61)).filter("job_id = 'j2'"), "reason") == [("retry",)]
    assert rows(jb.backlog(jobs, "2024-01-02 00:00:00"), "job_id", "reason") == [("j2", "retry"), ("j3", "stuck")]
    assert rows(jb.claimable(jobs, "2024-01-02 00:00:00"), "job_id") == [("j2",)]


def test_fair_order(spark):
    data = [(f"j{n}", 1 if n < 3 else 2, at(n)) for n in range(4)]
    ready = spark.createDataFrame(data, "job_id string, installation_id bigint, created_at timestamp_ntz")
    ordered = jb.fair_order(ready, bound=1).orderBy("round", "created_at").collect()
    assert [r.job_id for r in ordered] == ["j0", "j3", "j1", "j2"]


def test_billing(spark):
    sub_json = lambda s, items="[]": json.dumps({"id": "s1", "status": s, "current_period_end": 1700000000, "items": json.loads(items)})
    data = [
        ("e1", "customer.subscription.updated", "c1", sub_json("active", '[{"price":{"id":"p1"}}]'), at(1), 1),
        ("e1", "customer.subscription.updated", "c1", sub_json("unpaid"), at(1), 2),
        ("e2", "invoice.paid", "c1", sub_json("past_due"), at(0), 3),
        ("e3", "customer.subscription.updated", "nobody", sub_json("active"), at(2), 4),
        ("e4", "customer.created", "c1", sub_json("canceled"), at(3), 5),
        ("e5", "checkout.session.completed", "c1", None, at(4), 6),
    ]
    events = spark.createDataFrame(
        data, "id string, type string, customer_id string, subscription string, created timestamp_ntz, arrival_seq bigint"
    )
    subs = spark.createDataFrame(
        [(1, "c1", None, "incomplete", None, None), (2, "c2", None, "incomplete", None, None)],
        "user_id bigint, stripe_customer_id string, stripe_subscription_id string, status string, price_id string, "
        "current_period_end timestamp_ntz",
    )
    by_arrival = billing.billing_state(events, subs)
    assert rows(by_arrival, "user_id", "status", "price_id") == [(1, "past_due", None), (2, "incomplete", None)]
    assert rows(billing.billing_state(events, subs, "created"), "user_id", "status") == [(1, "active"), (2, "incomplete")]
    assert rows(billing.unknown_customers(events, subs), "id") == [("e3",)]
    users = spark.createDataFrame([(1,), (3,)], "user_id bigint")
    assert rows(billing.with_entitlement(users, by_arrival), "user_id", "active") == [(1, False), (3, False)]


def test_submissions(spark):
    good = {f: "x" for f in sub.FIELDS}
    bodies = [
        (1, json.dumps({"repo": "o/r", "ref": 5, "commitSha": None, "findings": [good] * 101})),
        (2, json.dumps({"findings": [{**good, "file": 7}, {**good, "line": 3}, "text", None, {"id": "a"}]})),
        (3, json.dumps({"findings": {}})), (4, "{nope"), (5, json.dumps({"findings": [], "pad": "x" * 524288})),
        (6, json.dumps({"findings": []})),
    ]
    parsed = sub.parse_submissions(spark.createDataFrame(bodies, "submission_id bigint, value string"))
    assert rows(parsed, "submission_id", "status", "repo", "ref", "valid") == [
        (1, "ok", "o/r", None, 101), (2, "ok", None, None, 1), (3, "no_findings_list", None, None, 0),
        (4, "not_json", None, None, 0), (5, "too_large", None, None, 0), (6, "ok", None, None, 0),
    ]
    assert rows(sub.submitted_findings(parsed).groupBy("submission_id").count(), "submission_id", "count") == [(1, 100), (2, 1)]
    result = sub.submission_result(parsed, F.col("submission_id") != 2, F.lit(True))
    assert rows(result, "submission_id", "enrichment", "enrichment_error", "ai_enriched") == [
        (1, "ok", None, True), (2, "unavailable", "subscription_required", False), (6, "ok", None, False)
    ]


def test_submissions_are_typed_outside_the_plan(spark):
    good = {f: "x" for f in sub.FIELDS}
    whole = json.dumps(good)[:-1]
    lines = {"3": 3, "3.9": 3, "2147483648": None, '" 5 "': 5, '"5.0"': None, "true": 1, "1e3": 1000, "[1]": None}
    texts = {
        **{f'{{"findings":[{whole},"line":{text}}}]}}': ("ok", 1) for text in lines},
        f'{{"findings":[{whole},"id":"y"}}]}}': ("not_json", 0), f'{{"findings":[{whole},"q" :"a:b"}}]}}': ("ok", 1),
        '{"findings":[],"a":{"b":1,"b":2}}': ("not_json", 0), '{"findings":[]} x': ("ok", 0), '{"findings":[],"a":NaN}': ("not_json", 0),
        '{"a":' + "[" * 999 + "]" * 999 + "}": ("no_findings_list", 0), '{"a":' + "[" * 1000 + "]" * 1000 + "}": ("not_json", 0),
        '{"a":' + "1" * 1000 + "}": ("no_findings_list", 0), '{"a":' + "1" * 1001 + "}": ("not_json", 0),
        f'{{"findings":[{whole},"codeSnippet":"\\ud800"}}]}}': ("ok", 1), "5 x": ("no_findings_list", 0), "5x": ("not_json", 0), "": ("not_json", 0),
    }
    bodies = spark.createDataFrame(list(enumerate([*texts, None])), "submission_id bigint, value string")
    parsed = sub.parse_submissions(bodies)
    outcome = lambda df: {r["submission_id"]: (r["status"], r["valid"]) for r in df.collect()}
    assert outcome(parsed) == dict(enumerate([*texts.values(), ("not_json", 0)]))
    found = {r["submission_id"]: r for r in sub.submitted_findings(parsed).collect()}
    assert [found[i]["line"] for i in range(len(lines))] == list(lines.values())
    assert "?" in {r["code_snippet"] for r in found.values()}
    # What the caller does not read is checked but not returned.
    few = sub.parse_submissions(bodies, kept=["severity", "line"])
    assert few.schema["findings"].dataType.elementType.names == ["severity", "line"]
    none = sub.parse_submissions(bodies, kept=[])
    assert "findings" not in none.columns
    for other in (few, none):
        assert outcome(other) == outcome(parsed)
    plan = parsed.filter("status = 'ok'")._jdf.queryExecution().optimizedPlan().toString()
    assert "variant" not in plan and plan.count("MapInArrow") == 1


def test_scan_requests(spark):
    repo = {"id": 5, "full_name": "o/r", "default_branch": "main"}
    push = {"installation": {"id": 1}, "repository": repo, "after": "abc", "ref": "refs/heads/main"}
    pull = {"installation": {"id": 1}, "repository": repo, "action": "opened",
            "pull_request": {"head": {"sha": "d", "ref": "f", "repo": {"id": 5}}}}
    cases = [
        ("push", push), ("push", {**push, "ref": "refs/heads/dev"}), ("push", {**push, "deleted": True}),
        ("push", {**push, "after": "0000"}), ("push", {**push, "installation": {"id": 2}}), ("push", {**push, "installation": None}),
        ("pull_request", pull), ("pull_request", {**pull, "action": "closed"}),
        ("pull_request", {**pull, "pull_request": {"head": {"sha": "d", "ref": "f", "repo": {"id": 6}}}}),
        ("pull_request", {**pull, "pull_request": {"head": {"sha": "d", "ref": "f", "repo": None}}}), ("ping", push),
    ]
    events = spark.createDataFrame(
        [(n, e, json.dumps(p), at(0)) for n, (e, p) in enumerate(cases)], "seq bigint, event string, payload string, ts timestamp_ntz"
    )
    installs = spark.createDataFrame([(1, 9, None), (2, 8, at(0))], "installation_id bigint, user_id bigint, suspended_at timestamp_ntz")
    assert rows(ev.scan_requests(events, installs), "seq", "head_sha", "ref", "is_pull_request", "user_id") == [
        (0, "abc", "refs/heads/main", False, 9), (6, "d", "f", True, 9)
    ]


def test_keys_and_purge(spark):
    keys = spark.createDataFrame([("k1", 1, None), ("k2", 2, at(0))], "id string, user_id bigint, revoked_at timestamp_ntz")
    keys = keys.withColumn("key_hash", k.token_hash(F.concat(F.lit("pflt_"), "id")))
    headers = ["Bearer pflt_k1", "Bearer  pflt_k1", "Bearer pflt_k2", "bearer pflt_k1", "Bearer k1", "Bearer pflt_k1 x", None]
    calls = spark.createDataFrame(list(enumerate(headers)), "call_id bigint, header string")
    assert rows(tn.resolve_keys(calls, keys), "call_id", "api_key_id") == [(0, "k1"), (1, "k1")]
    asked = spark.createDataFrame([(1, "k1"), (1, "k2"), (2, "k2")], "user_id bigint, id string")
    revoked = tn.revoke(keys, asked, "2024-03-01 00:00:00")
    assert rows(revoked, "id", "revoked_at") == [("k1", dt.datetime(2024, 3, 1)), ("k2", at(0))]
    left = tn.purge({"api_keys": keys, "analysis_cache": keys}, spark.createDataFrame([(1,)], "user_id bigint"))
    assert (left["api_keys"].count(), left["analysis_cache"].count()) == (1, 2)


def test_setup_gate_state(spark):
    schema = (
        "user_id bigint, repo_full_name string, installation_id bigint, default_branch string, workflow_state string, "
        "secret_state string, api_key_id string, gate_provider string, gate_state string, gate_last_checked_at timestamp_ntz, last_error string"
    )
    base = [(u, "o/r", 1, "main", "created", "set", "k", "vercel", "required", at(1), None) for u in (1, 2, 3)]
    setups = spark.createDataFrame(base, schema)
    run = lambda u, seq, p, err=None: (u, "o/r", seq, 1, "main", "pending", "pending", "k", p, err)
    runs = spark.createDataFrame(
        [run(1, 1, "vercel", "boom"), run(2, 1, "netlify"), run(2, 2, "vercel"), run(4, 1, "netlify")],
        "user_id bigint, repo_full_name string, seq bigint, installation_id bigint, default_branch string, workflow_state string, "
        "secret_state string, api_key_id string, gate_provider string, error string",
    )
    got = st.apply_setup_events(setups, runs)
    assert rows(got, "user_id", "gate_state", "gate_provider", "workflow_state", "last_error") == [
        (1, "required", "vercel", "error", "boom"), (2, "unverified", "vercel", "pending", None),
        (3, "required", "vercel", "created", None), (4, "unverified", "netlify", "pending", None),
    ]
    results = spark.createDataFrame([(3, "o/r", "error", at(9)), (2, "o/r", "required", at(9))],
                                    "user_id bigint, repo_full_name string, state string, ts timestamp_ntz")
    checked = st.apply_recheck(got, results)
    assert rows(checked.filter("user_id in (2, 3)"), "user_id", "gate_state", "gate_last_checked_at") == [
        (2, "required", at(9)), (3, "required", at(9))
    ]


def test_rule_order_of_large_files(spark):
    """More than 64 matches in one file, file numbers beyond 2^31, findings without a file."""
    places = [(c, 0, f, s, p) for c in (0, 1) for f in (0, 1 << 31, 1 << 40) for s in (0, 1) for p in range(70)] + [(0, 0, None, 0, 0), (1, 0, None, 0, 0)]
    places.sort(key=lambda x: (x[0], x[1], -1 if x[2] is None else x[2], *x[3:]))
    # Ids and details run against the order.
    rows = [("a", *x, "HIGH", f"{9999 - n}", f"{9999 - n}") for n, x in enumerate(places)]
    df = spark.createDataFrame(rows[::-1], "project_id string, check_no int, phase int, file_seq bigint, step int, pos int, severity string, id string, detail string")
    for by_severity in (False, True):
        got = report.number_findings(df.withColumn("ord", report.rule_order()), ["project_id"], by_severity).orderBy("position").collect()
        assert [r.position for r in got] == list(range(1, len(rows) + 1))
        assert [r.id for r in got] == [r[7] for r in rows]
    named = df.withColumn("file_seq", F.lpad(F.col("file_seq").cast("string"), 20, "0")).withColumn("ord", report.rule_order())
    got = report.number_findings(named, ["project_id"], False).orderBy("position").collect()
    assert [r.id for r in got] == [r[7] for r in rows]
