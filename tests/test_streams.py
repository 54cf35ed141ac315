"""Streams over several micro-batches give what the batch operators give."""

import datetime as dt

from pyspark.sql import functions as F

from plumbline.operators import billing, jobs as jb, limits
from plumbline.plans.streams import StreamTables
from plumbline.plans.views import Tables
from plumbline.streaming import jobs as sj, ledger, limits as sl
from plumbline.streaming.scans import FINDINGS, SCANS, scan_step
from plumbline.streaming.store import BatchStore, run


def split(spark, df, folder, order, parts=3):
    """Write ``df`` as files that arrive one after another."""
    count = df.count()
    for n in range(parts):
        low, high = count * n // parts, count * (n + 1) // parts
        df.filter((F.col(order) >= low) & (F.col(order) < high)).coalesce(1).write.parquet(f"{folder}/{n}")


def stream(spark, df, folder):
    return (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        .parquet(str(folder))
    )


def same(a, b):
    columns = sorted(a.columns)
    return a.select(*columns).exceptAll(b.select(*columns)).count() == 0 == b.select(*columns).exceptAll(
        a.select(*columns)).count()


def events(spark, n=240):
    return spark.range(n).select(
        F.col("id").alias("event_id"), (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 3).cast("int"))).alias("ts"),
        (F.col("id") * 7 % 9).alias("user_id"),
    )


class Live(StreamTables):
    def __init__(self, spark, df, folder):
        super().__init__(spark, str(folder))
        self.df = df

    def table(self, name):
        return stream(self.spark, self.df, self.sf_dir)


class Still(Tables):
    def __init__(self, spark, df):
        super().__init__(spark, "")
        self.df = df

    def table(self, name):
        return self.df


def test_billing_stream(spark, tmp_path):
    df = events(spark).cache()
    split(spark, df, tmp_path / "in", "event_id")
    subs = spark.range(9).select(
        F.col("id").alias("user_id"), F.concat(F.lit("cus_"), F.col("id").cast("string")).alias("stripe_customer_id"),
        F.lit(None).cast("string").alias("stripe_subscription_id"), F.lit("incomplete").alias("status"),
        F.lit(None).cast("string").alias("price_id"), F.lit(None).cast("timestamp_ntz").alias("current_period_end"),
    )
    deliveries = Still(spark, df).billing_events()
    # The repeats come with their originals' files here, so their arrival is moved behind each original only.
    store = BatchStore(spark, str(tmp_path / "store"))
    run(Live(spark, df, tmp_path / "in").billing_events(), ledger.billing_step(store, subs), str(tmp_path / "cp")).awaitTermination()
    assert same(ledger.event_ledger(store).read().select("id", "arrival_seq"),
                billing.first_deliveries(deliveries).select("id", "arrival_seq"))
    assert same(ledger.subscription_state(store, subs), billing.billing_state(deliveries, subs).select(*subs.columns))
    assert same(store.read("unknown", billing.unknown_customers(deliveries, subs).schema), billing.unknown_customers(deliveries, subs))


def test_replay_changes_nothing(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path / "store"))
    subs = spark.createDataFrame([(1, "cus_1", None, "incomplete", None, None)],
                                 "user_id bigint, stripe_customer_id string, stripe_subscription_id string, status string, "
                                 "price_id string, current_period_end timestamp_ntz")
    batch = Still(spark, events(spark, 40)).billing_events()
    step = ledger.billing_step(store, subs)
    step(batch, 0)
    before = ledger.event_ledger(store).read().count()
    step(batch, 0)
    step(batch, 1)
    assert ledger.event_ledger(store).read().count() == before


def test_failed_events_are_taken_again(spark, tmp_path):
    """A failing handler releases the id: the next delivery is handled, in the same batch or a later one."""
    rows = [(f"e{n}", "invoice.paid", f"cus_{n}", None, None, n) for n in range(6)]
    again = [(f"e{n}", "invoice.paid", f"cus_{n}", None, None, 10 + n) for n in range(4)]
    later = [(f"e{n}", "invoice.paid", f"cus_{n}", None, None, 20 + n) for n in range(5)]
    schema = "id string, type string, customer_id string, subscription string, created timestamp_ntz, arrival_seq bigint"
    subs = spark.createDataFrame([], "user_id bigint, stripe_customer_id string, stripe_subscription_id string, status string, "
                                     "price_id string, current_period_end timestamp_ntz")
    bad = {0, 1, 2, 11, 12, 4, 22}  # arrivals that fail: e0 once, e1 and e2 twice, e4 once, e2 a third time
    tried = []

    def handler(events):
        tried.extend(r.arrival_seq for r in events.collect())
        return events.filter(F.col("arrival_seq").isin(bad)).select("id")

    store = BatchStore(spark, str(tmp_path))
    step = ledger.billing_step(store, subs, handler)
    step(spark.createDataFrame(rows + again, schema), 0)
    got = lambda: {r.id: r.arrival_seq for r in ledger.event_ledger(store).read().collect()}
    assert got() == {"e0": 10, "e3": 3, "e5": 5} and sorted(tried) == [0, 1, 2, 3, 4, 5, 10, 11, 12]
    step(spark.createDataFrame(later, schema), 1)
    assert got() == {"e0": 10, "e1": 21, "e3": 3, "e4": 24, "e5": 5}
    step(spark.createDataFrame(later, schema).withColumn("arrival_seq", F.col("arrival_seq") + 10), 2)
    assert got() == {"e0": 10, "e1": 21, "e2": 32, "e3": 3, "e4": 24, "e5": 5}


def requests_of(spark):
    n = F.col("id")
    return spark.range(90).select(
        n.alias("seq"), (n % 2).alias("installation_id"), F.lit("o/r").alias("repo_full_name"), (n % 2 + 1).alias("repo_id"),
        F.concat(F.lit("s"), F.floor(n * 13 % 31 / 2).cast("string")).alias("head_sha"), F.lit("main").alias("ref"),
        (n % 5 == 0).alias("is_pull_request"), F.lit(9).cast("long").alias("user_id"),
    ).cache()


def test_jobs_stream(spark, tmp_path):
    requests = requests_of(spark)
    split(spark, requests, tmp_path / "in", "seq")
    columns = ["seq", "repo_id", "head_sha", "status", "closed_by_seq", "note"]
    claims = jb.jobs_from_events(requests).filter(F.col("seq") % 3 == 0).select("repo_id", "head_sha", (F.col("seq") + 4).alias("claim_seq"))
    for name, given in (("free", None), ("claimed", claims)):
        store = BatchStore(spark, str(tmp_path / name))
        step = sj.jobs_step(store, bound=8, claims=None if given is None else lambda given=given: given, width=2, buckets=4)
        run(stream(spark, requests, tmp_path / "in"), step, str(tmp_path / f"cp-{name}")).awaitTermination()
        want = jb.supersede(requests, given, bound=8)
        assert same(sj.all_jobs(store, 2, 4).read().withColumn("status", F.when(F.col("closed_by_seq").isNotNull(), "done").otherwise("queued")).select(*columns),
                    want.select(*columns))
    left = sj.open_jobs(store, 2, 4).read()
    assert left.count() < want.filter("status = 'queued'").count()  # claimed jobs wait for nothing


def test_cache_stream_writes_changes_only(spark, tmp_path):
    from plumbline.operators import enrichment as en
    from plumbline.streaming import cache as sc

    fields = ["'r' req_id", "'t' req_title", "'low' likely", "concat('was ', id) explanation", "array('s') steps", "cast(null as string) example"]
    initial = spark.range(2000).selectExpr(
        "concat('k', id) cache_key", *fields, "'old' model", "timestamp_ntz'2024-01-01 00:00:00' created_at", "id % 3 hit_count")
    fresh = lambda low, high: spark.range(low, high).selectExpr(
        "concat('k', id) cache_key", "id ord", "concat('f', id) id", *[f.replace("was ", "now ") for f in fields])
    used = lambda number: spark.createDataFrame([(f"k{number}", 5)], "cache_key string, hits bigint")
    store = BatchStore(spark, str(tmp_path))
    step = sc.cache_step(store, "new", "2024-06-01 00:00:00", initial, used, width=2, buckets=4)
    want = initial
    for number, rows in enumerate([fresh(10, 30), fresh(20, 40), fresh(1990, 2010)]):
        want = en.cache_upsert(want, rows, "new", "2024-06-01 00:00:00", used(number))
        step(rows, number)
        written = spark.read.schema(en.CACHE_SCHEMA).parquet(str(tmp_path / "cache" / f"span={number}-{number + 1}")).count()
        assert written == 21  # 20 answers and one hit among 2,000 entries
    assert same(sc.cache_log(store, initial, 2, 4).read(), want)


def test_keyed_log(spark, tmp_path):
    """Random writes against a dictionary, with replays, skipped batches, tombstones and merges on three levels."""
    import random

    from plumbline.streaming.store import KeyedLog

    r, truth, store = random.Random(4), {}, BatchStore(spark, str(tmp_path))
    log = KeyedLog(store, "log", "k bigint, v bigint", ["k"], width=2, buckets=8)
    seen = {}
    for batch in range(18):
        rows = {r.randrange(300): (r.randrange(10**6), r.random() < 0.3) for _ in range(25)}
        if batch not in (5, 11):
            for _ in range(2 if batch in (3, 7) else 1):  # a batch that failed after writing is repeated
                log.write(batch, spark.createDataFrame([(k, v, g) for k, (v, g) in rows.items()], "k bigint, v bigint, g boolean"), gone=F.col("g"))
            for k, (v, gone) in rows.items():
                truth.pop(k, None) if gone else truth.__setitem__(k, v)
        seen[batch + 1] = dict(truth)
    for before in (17, 18):  # the state that a repeated last batch reads, and the present one
        if before == 18:
            assert {x.k: x.v for x in log.read().collect()} == truth
        assert {x.k: x.v for x in log.read(before).collect()} == seen[before]
    assert len(log.spans(0, 18)) <= 5
    some = spark.createDataFrame([(7,), (8,)], "k bigint")
    buckets = log.touched(some)
    pruned = log._rows(log.spans(0, 16), buckets, None)
    assert 0 < len(buckets) <= 2 and len(pruned.inputFiles()) >= 1
    assert pruned.count() < 0.6 * log._rows(log.spans(0, 16), None, None).count()
    assert {x.k: x.v for x in log.read(18, buckets).join(some, "k", "left_semi").collect()} == {k: v for k, v in truth.items() if k in (7, 8)}


def test_limiter_state_stays_small(spark, tmp_path):
    """A thousand windows go by; the state keeps the live ones, and verdicts equal the batch operator's."""
    calls = spark.range(3024).select(
        F.col("id").alias("call_id"), (F.col("id") % 2).cast("string").alias("subject"),
        (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 20)).alias("ts")).cache()
    store = BatchStore(spark, str(tmp_path))
    step = sl.verdict_step(store, 60, 1, grace_windows=2, width=3, buckets=2)
    log, kept, stored = sl.live_windows(store, 3, 2), [], []
    for number in range(9):
        step(calls.filter((F.col("call_id") >= number * 336) & (F.col("call_id") < (number + 1) * 336)), number)
        if number in (2, 5, 8):
            stored.append(log._rows(log.spans(0, number + 1), None, None).count())
            kept.append(log.read(number + 1, horizon=sl_horizon(store, number)).count())
    assert same(store.read("verdicts", sl.VERDICTS), limits.rate_limit(calls, 60, 1).select("call_id", "subject", "nth", "ok", "retry_after_sec"))
    assert max(kept) <= 8 and max(stored) <= 3 * 2 * 112 + 8  # of 2,016 windows of both subjects, three batches' worth
    # A call of a window that was swept long ago is let through and told apart.
    late = spark.createDataFrame([(9999, "0", dt.datetime(2024, 1, 1))], "call_id bigint, subject string, ts timestamp_ntz")
    step(late, 9)
    assert [tuple(x) for x in store.read("late", sl.LATE).collect()] == [(9999, "0", 28401120)]
    assert [(x.nth, x.ok) for x in store.read("verdicts", sl.VERDICTS).filter("call_id = 9999").collect()] == [(None, True)]


def sl_horizon(store, number):
    from plumbline.streaming.store import KeyedLog

    return KeyedLog(store, "clock", sl.CLOCK, ["name"], width=3, buckets=1).read(number + 1).first().now_ms - 2 * 60_000


def test_limit_stream(spark, tmp_path):
    calls = events(spark).select(F.col("event_id").alias("call_id"), F.col("user_id").cast("string").alias("subject"), "ts").cache()
    split(spark, calls, tmp_path / "in", "call_id")
    store = BatchStore(spark, str(tmp_path / "store"))
    run(stream(spark, calls, tmp_path / "in"), sl.verdict_step(store, 7200, 3), str(tmp_path / "cp")).awaitTermination()
    want = limits.rate_limit(calls, 7200, 3).select("call_id", "subject", "nth", "ok", "retry_after_sec")
    got = store.read("verdicts", sl.VERDICTS)
    assert same(got, want) and got.filter("NOT ok").count() > 0


def test_late_calls_are_counted(spark, tmp_path):
    # Newest calls first: each later file is hours behind any watermark.
    calls = events(spark).select((239 - F.col("event_id")).alias("call_id"), F.col("user_id").cast("string").alias("subject"), "ts").cache()
    split(spark, calls, tmp_path / "in", "call_id")
    store = BatchStore(spark, str(tmp_path / "store"))
    run(stream(spark, calls, tmp_path / "in"), sl.window_step(store, 3600), str(tmp_path / "cp")).awaitTermination()
    assert same(sl.window_totals(store), limits.window_counts(calls, 3600).drop("expires_ms"))
    assert sl.window_totals(store).agg(F.sum("calls")).first()[0] == 240


def test_limit_of_one_window(spark):
    calls = spark.createDataFrame(
        [(n, "s", dt.datetime(2024, 1, 1, 0, 0, 3 * n)) for n in range(7)] + [(7, "s", dt.datetime(2024, 1, 1, 0, 1))],
        "call_id bigint, subject string, ts timestamp_ntz",
    )
    got = {r.call_id: (r.ok, r.retry_after_sec) for r in limits.rate_limit(calls).collect()}
    assert got == {**{n: (True, 0) for n in range(6)}, 6: (False, 42), 7: (True, 0)}


def test_scan_stream(spark, tmp_path):
    texts = {1: "eval(a)", 2: "eval(a)\neval(b)", 3: "eval(a)\neval(b)", 4: "x"}
    commits = spark.createDataFrame(
        [(1, 7, "o/r", False, 1), (2, 7, "o/r", True, 2), (3, 7, "o/r", False, 3), (4, 7, "o/r", False, 4)],
        "scan_id bigint, installation_id bigint, repo string, is_pull_request boolean, m int",
    ).withColumn("created_at", F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), "m", F.lit(0))).drop("m")
    files = spark.createDataFrame(
        [(str(s), n, p, t) for s, t in texts.items() for n, p, t in [(0, "a.ts", t), (1, "a.sql", "")]],
        "project_id string, file_seq bigint, path string, content string",
    )
    load = lambda c: files.join(c.select(F.col("scan_id").cast("string").alias("project_id")), "project_id", "left_semi")
    store = BatchStore(spark, str(tmp_path))
    step = scan_step(store, load)
    step(commits.filter("scan_id <= 3"), 0)
    step(commits.filter("scan_id = 4"), 1)
    got = {r.scan_id: (r.findings_count, r.new_count, r.conclusion) for r in store.read("scans", SCANS).collect()}
    assert got == {1: (1, 1, "success"), 2: (2, 1, "success"), 3: (2, 1, "success"), 4: (0, 0, "success")}
    kept = store.read("scan_findings", FINDINGS).filter("scan_id = 3")
    assert sorted((r.line, r.status) for r in kept.collect()) == [(1, "carried"), (2, "new")]
    whole = BatchStore(spark, str(tmp_path / "whole"))
    scan_step(whole, load)(commits, 0)
    assert same(whole.read("scans", SCANS), store.read("scans", SCANS))
    assert same(whole.read("scan_findings", FINDINGS), store.read("scan_findings", FINDINGS))


def test_streamed_findings_keep_rule_order(spark, tmp_path):
    """Findings of two files, several rules and many matches come out position by position as from the batch scan."""
    from plumbline.operators.report import number_findings, rule_order
    from plumbline.operators.scan import scan_projects

    code = "eval(a)\n" * 70 + "const f = new Function('x');\n" + "db.execute('select ' + a);\n" * 3
    files = spark.createDataFrame(
        [("1", n, p, t) for n, (p, t) in enumerate([("z.ts", code), ("a.ts", code), ("t.sql", "create table t (id int);\n" * 2), ("m.ts", "eval(b)")])],
        "project_id string, file_seq bigint, path string, content string")
    commits = spark.createDataFrame(
        [(1, 7, "o/r", False, dt.datetime(2024, 1, 1))], "scan_id bigint, installation_id bigint, repo string, is_pull_request boolean, created_at timestamp_ntz")
    store = BatchStore(spark, str(tmp_path))
    scan_step(store, lambda c: files)(commits, 0)
    shown = ["position", "severity", "title", "file", "line"]
    want = number_findings(scan_projects(files).withColumn("ord", rule_order()), ["project_id"], by_severity=False).select(*shown)
    got = number_findings(store.read("scan_findings", FINDINGS), ["scan_id"], by_severity=False).select(*shown)
    assert same(got, want) and got.count() > 140
    places = [(r.file, r.line) for r in got.orderBy("position").collect()]
    assert places.index(("a.ts", 1)) > places.index(("z.ts", 70))  # file by file, not by path or id
