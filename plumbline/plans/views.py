"""Inputs of the operators, derived from the given tables.

The given texts hold none of the rules' patterns, so each document gets a path and one extra snippet,
both chosen by its id; the whole text stays in front. Every view has a Spark form here and a SQL form in
``oracle.py`` built from the same lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.keys import finding_id
from plumbline.session import spread_by_key, spread_small_input

PATHS = [
    "app/d{n}/route.ts", "pages/api/d{n}.js", "lib/m{n}.ts", "db/{n}.sql", "config/{n}/next.config.js",
    "src/{n}/middleware.ts", "components/C{n}.tsx", "node_modules/p{n}/index.js", "lib/m{n}.TS",
    "lib/t{n}.example.ts", "./actions/a{n}.mjs", "win\\d{n}\\util.cjs", "docs/readme{n}.md",
    "migrations/{n}_init.sql", "apps/web/app/x{n}/route.tsx", "x{n}/build",
]
QUIET_PROJECTS = ["src0", "src1"]
QUIET_KINDS = [3, 4, 13]
SNIPPETS = [
    "const a = process.env.NEXT_PUBLIC_SERVICE_ROLE_KEY; const b = process.env.NEXT_PUBLIC_X{n}_TOKEN;",
    "const a = process.env.NEXT_PUBLIC_ANON_KEY + process.env.NEXT_PUBLIC_CANONICAL_SECRET;\nprocess.env.NEXT_PUBLIC_PLAIN",
    "  'use client';\nexport const a = 1;\nconst k = env.SERVICE_ROLE ?? 'service_role';",
    "const u = 'postgres://app:" + "real{n}" + "@db{n}.example.com/a';\nconst v = 'postgresql://app:changeme@db/a';\n"
    "const w = \"postgres://app:pw@localhost:5432/a\", x = 'postgres://u:<pw>@h/d';",
    "create table t{n} (id int);\nCREATE TABLE IF NOT EXISTS public.shared (id int);",
    "alter table shared enable row level security;\ncreate table t{n} (id int);\nALTER TABLE if exists \"t{n}\" ENABLE ROW LEVEL SECURITY;",
    "create policy p on t using (true);\ncreate policy q on t with check ( TRUE ) using( true );",
    "export const GET = () => supabase.from('users').select();",
    "\"use server\";\nexport const save = (r) => prisma.user.create(r);",
    "const s = await getSession (req);\nawait db.select();",
    "module.exports = {};",
    "module.exports = { async headers() { return ['Content-Security-Policy']; } };",
    "const a = '" + "AKIA" + "IOSFODNN7EXAMPLE', b = '" + "ghp" + "_" + "A" * 36 + "';",
    "// key\nconst s = '" + "sk" + "_live_" + "0" * 24 + "';",
    "const s = '" + "xox" + "b-" + "0" * 20 + "';\nconst k = `-----BEGIN RSA " + "PRIVATE" + " KEY-----`;",
    "pool.query(\n  `select * from t where id = ${id}`);",
    "db.execute('select ' + a); db.raw(\"x\" +\n b);",
    "eval(a); eval (b);\nconst f = new  Function('return 1');",
    "<p dangerouslySetInnerHTML={{ __html: body }} />",
    "<p dangerouslySetInnerHTML={{\n  __html:\n body }} /> <p dangerouslySetInnerHTML={{ __html: 'x' }} />\n"
    "<p dangerouslySetInnerHTML={{ __html: DOMPurify.sanitize(b) }} />",
    "export default requireAuth(handler);",
    "create table \"public\".\"orders{n}\" (id int);\ncreate table if not exists `logs` (id int);",
    "export const nothing = {n};",
    "import { currentUser } from '@clerk/nextjs';\nexport const x = drizzle(db);",
]


#: What is wrong with the archive of a document, by its number modulo 50, and the limit that over-long ones break.
ARCHIVE_FAULTS = {7: "broken", 13: "cut", 21: "too_large", 29: "empty", 33: "not_gzip", 41: "missing"}
ARCHIVE_LIMIT = 2_000_000


def _pick(values: list[str], index: Column, n: Column) -> Column:
    chosen = F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)
    return F.replace(chosen, F.lit("{n}"), n.cast("string"))


class Tables:
    """The given tables of one scale and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def files(self, project: Column | None = None) -> DataFrame:
        """documents → files(project_id, file_seq, path, content)."""
        doc = F.col("doc_id")
        kind = F.floor(doc / 20) % 16
        quiet = F.col("source").isin(QUIET_PROJECTS) & kind.isin(QUIET_KINDS)
        path = F.when(quiet, F.concat(F.lit("notes/n"), doc.cast("string"), F.lit(".txt")))
        snippet = _pick(SNIPPETS, F.floor(doc / 7) % len(SNIPPETS), doc)
        return spread_small_input(self.table("documents"), "doc_id").select(
            (F.col("source") if project is None else project).alias("project_id"),
            doc.alias("file_seq"),
            path.otherwise(_pick(PATHS, kind, doc)).alias("path"),
            F.concat(F.col("text"), F.lit("\n"), snippet, F.lit("\n")).alias("content"),
        )

    def scans(self) -> DataFrame:
        """orders → scans; every tenth user scans without an installation."""
        user, scan = F.col("o_custkey"), F.col("o_orderkey")
        is_pr = F.col("o_orderstatus") == "P"
        return self.table("orders").select(
            scan.alias("scan_id"), user.alias("user_id"),
            F.when(user % 10 == 0, F.concat(F.lit("key"), user.cast("string"))).alias("api_key_id"),
            F.when(user % 10 != 0, user).alias("installation_id"),
            F.when(scan % 11 != 0, F.concat(F.lit("org/r"), (scan % 3).cast("string"))).alias("repo"),
            F.when(is_pr, "feature").otherwise("refs/heads/main").alias("ref"),
            F.substring(F.sha2(scan.cast("string"), 256), 1, 40).alias("commit_sha"),
            is_pr.alias("is_pull_request"),
            (F.col("o_orderpriority") == "1-URGENT").alias("ai_enriched"),
            F.col("o_orderdate").alias("created_at"),
        )

    def scan_findings(self) -> DataFrame:
        """lineitem → findings of scans; ids repeat within and across scans."""
        part, line, supp = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")
        text = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
        severity = (
            F.when((F.col("l_returnflag") == "A") & (line <= 2), "HIGH")
            .when(F.col("l_returnflag") == "R", "MEDIUM").when(line <= 4, "LOW").when(supp % 13 == 0, "CRITICAL")
            .otherwise("INFO")
        )
        category = (
            F.when(part % 4 == 0, "ACCESS").when(part % 4 == 1, "SECRETS").when(part % 4 == 2, "CONFIG")
            .when(supp % 9 == 0, "ASVS: Security Configuration").otherwise("INJECTION")
        )
        file = F.when(part % 10 == 9, "(project)").otherwise(
            text("lib/f", (part % 10).cast("string"), ".ts")
        )
        title = text("Rule ", (part % 5).cast("string"))
        number = F.when(supp % 7 != 0, line.cast("int"))
        return spread_by_key(self.table("lineitem"), "l_orderkey").select(
            F.col("l_orderkey").alias("scan_id"),
            (line.cast("long") * 100000 + part % 100000).alias("ord"),
            finding_id(file, title, number).alias("id"),
            severity.alias("severity"),
            F.when(F.col("l_linestatus") == "O", "definitive").otherwise("heuristic").alias("confidence"),
            category.alias("asvs_category"), title.alias("title"), file.alias("file"), number.alias("line"),
            text(
                "qty ", F.col("l_quantity").cast("long").cast("string"), " part ", part.cast("string"),
                " supp ", supp.cast("string"), " ", F.col("l_returnflag"), F.col("l_linestatus"),
            ).alias("detail"),
            F.when(part % 8 == 0, "").otherwise(text("Fix ", (part % 5).cast("string"))).alias("remediation"),
            F.when(supp % 5 == 0, text("code ", supp.cast("string"))).alias("code_snippet"),
        )

    def api_calls(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("call_id"),
            F.concat(F.lit("apikey:"), F.col("user_id").cast("string")).alias("subject"), F.col("ts"),
        )

    def repo_events(self) -> DataFrame:
        """events → repo_events(seq, event, payload JSON, ts)."""
        n, user = F.col("event_id"), F.col("user_id")
        text = lambda *xs: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in xs])
        kind = F.col("event_type")
        name = text("org", user % 20, "/r", n % 3)
        repo_id = F.when(n % 50 != 0, (user % 20) * 10 + n % 3 + 1)
        sha = F.when(n % 37 == 0, "0000000000").otherwise(text("a", F.floor(n / 2000), "x", n % 40))
        push, pull, install, repos = (kind == k for k in ("click", "view", "error", "signup"))
        action = (
            F.when(pull, F.element_at(F.array(*map(F.lit, ["opened", "synchronize", "closed", "reopened"])), (n % 4).cast("int") + 1))
            .when(install & (n % 97 == 0), "deleted")
            .when(install, F.element_at(F.array(*map(F.lit, ["suspend", "unsuspend", "created"])), (n % 3).cast("int") + 1))
            .when(repos, F.when(n % 2 == 0, "removed").otherwise("added"))
        )
        head_repo = F.when(n % 11 != 0, F.struct(F.when(n % 7 == 0, repo_id + 1000).otherwise(repo_id).alias("id")))
        payload = F.struct(
            action.alias("action"),
            F.when(n % 53 != 0, F.struct(user.alias("id"))).alias("installation"),
            F.when(
                repos,
                F.array(
                    F.struct(F.lit(1).alias("id"), name.alias("full_name")),
                    F.struct(F.lit(2).alias("id"), F.lit(None).cast("string").alias("full_name")),
                ),
            ).alias("repositories_removed"),
            F.when(push, F.when(n % 5 != 0, "refs/heads/main").otherwise("refs/heads/dev")).alias("ref"),
            F.when(push, sha).alias("after"),
            F.when(push, n % 41 == 0).alias("deleted"),
            F.when(
                push | pull,
                F.struct(repo_id.alias("id"), name.alias("full_name"), F.lit("main").alias("default_branch")),
            ).alias("repository"),
            F.when(
                pull,
                F.struct(
                    F.struct(sha.alias("sha"), text("feat", n % 2).alias("ref"), head_repo.alias("repo")).alias("head")
                ),
            ).alias("pull_request"),
        )
        event = (
            F.when(push, "push").when(pull, "pull_request").when(install, "installation")
            .when(repos, "installation_repositories").otherwise("ping")
        )
        return self.table("events").select(
            n.alias("seq"), event.alias("event"), F.to_json(payload).alias("payload"), F.col("ts")
        )

    def installations(self) -> DataFrame:
        """customer → installations; every ninth customer never installed."""
        key = F.col("c_custkey")
        return self.table("customer").filter(key % 9 != 0).select(
            key.alias("installation_id"), F.col("c_name").alias("account_login"),
            F.when(F.col("c_nationkey") % 2 == 0, "User").otherwise("Organization").alias("account_type"),
            (key + 1000000).alias("user_id"),
            F.when(key % 13 == 0, F.lit("2023-12-01 00:00:00").cast("timestamp_ntz")).alias("suspended_at"),
        )

    def repo_setups(self) -> DataFrame:
        key = F.col("c_custkey")
        pick = lambda values, index: F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)
        return self.table("customer").filter(key % 6 != 0).select(
            (key + 1000000).alias("user_id"), key.alias("installation_id"),
            F.concat(F.lit("org"), (key % 20).cast("string"), F.lit("/r"), (key % 3).cast("string")).alias("repo_full_name"),
            F.when(key % 4 != 0, "main").alias("default_branch"), F.lit("created").alias("workflow_state"),
            pick(["set", "pending"], key % 2).alias("secret_state"),
            F.concat(F.lit("k"), key.cast("string")).alias("api_key_id"),
            pick(["vercel", "netlify", "cloudflare", "gone"], F.floor(key / 2) % 4).alias("gate_provider"),
            pick(["unverified", "required", "error"], F.floor(key / 3) % 3).alias("gate_state"),
            F.when(
                key % 5 != 0, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(key % 20).cast("int"))
            ).alias("gate_last_checked_at"),
            F.lit(None).cast("string").alias("last_error"),
        )

    def api_keys(self) -> DataFrame:
        key = F.col("c_custkey")
        text = key.cast("string")
        return self.table("customer").select(
            F.concat(F.lit("k"), text).alias("id"), key.alias("user_id"), F.col("c_name").alias("name"),
            F.sha2(F.concat(F.lit("pflt_tok"), text), 256).alias("key_hash"),
            F.concat(F.lit("pflt_tok"), text).substr(1, 13).alias("key_prefix"),
            (F.lit("2023-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=(key % 300).cast("int"))).alias("created_at"),
            F.lit(None).cast("timestamp_ntz").alias("last_used_at"),
            F.when(key % 11 == 0, F.lit("2023-12-31 00:00:00").cast("timestamp_ntz")).alias("revoked_at"),
        )

    def bearer_calls(self) -> DataFrame:
        n, user = F.col("event_id"), F.col("user_id").cast("string")
        header = (
            F.when(n % 6 == 0, F.concat(F.lit("bearer pflt_tok"), user))
            .when(n % 6 == 1, F.concat(F.lit("Bearer other_"), user))
            .when(n % 6 == 2, F.concat(F.lit("Bearer  pflt_tok"), user, F.lit(" x")))
            .when(n % 6 == 3, F.concat(F.lit("Bearer   pflt_tok"), user))
            .when(n % 6 == 4, F.concat(F.lit("Bearer pflt_tok"), user))
        )
        return self.table("events").select(n.alias("call_id"), header.alias("header"), F.col("ts"))

    def job_events(self) -> DataFrame:
        n, user = F.col("event_id"), F.col("user_id")
        kinds = ["queued", "claimed", "failed", "claimed", "done", "check_opened", "failed", "superseded"]
        event = F.element_at(F.array(*map(F.lit, kinds)), (F.floor(n / 4) % 8).cast("int") + 1)
        return self.table("events").select(
            F.concat(F.lit("j"), user.cast("string"), F.lit("-"), (n % 4).cast("string")).alias("job_id"),
            (user % 25).alias("installation_id"), event.alias("event"), n.alias("seq"), F.col("ts"),
            F.concat(F.lit("err "), n.cast("string")).alias("error"), n.alias("check_run_id"),
        )

    def billing_events(self) -> DataFrame:
        """Every tenth event is delivered again, later and with another status."""
        n, user = F.col("event_id"), F.col("user_id")
        types = [
            "checkout.session.completed", "customer.subscription.created", "customer.subscription.updated",
            "customer.subscription.deleted", "customer.subscription.trial_will_end", "invoice.paid",
            "invoice.payment_failed", "customer.created",
        ]
        states = ["active", "trialing", "past_due", "canceled", "unpaid", "incomplete"]
        pick = lambda values, index: F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)

        def delivery(status, arrival):
            sub = F.struct(
                F.concat(F.lit("sub_"), user.cast("string")).alias("id"), status.alias("status"),
                (F.lit(1700000000) + n).alias("current_period_end"),
                F.when(
                    n % 4 != 0,
                    F.array(F.struct(F.struct(F.concat(F.lit("price_"), (n % 3).cast("string")).alias("id")).alias("price"))),
                ).otherwise(F.expr("array()").cast("array<struct<price:struct<id:string>>>")).alias("items"),
            )
            return [
                F.concat(F.lit("evt_"), n.cast("string")).alias("id"), pick(types, n % 8).alias("type"),
                F.when(n % 29 != 0, F.concat(F.lit("cus_"), user.cast("string"))).alias("customer_id"),
                F.when(n % 31 != 0, F.to_json(sub)).alias("subscription"), F.col("ts").alias("created"),
                arrival.alias("arrival_seq"),
            ]

        events = self.table("events")
        once = events.select(*delivery(pick(states, n % 6), n))
        again = events.filter(n % 10 == 0).select(*delivery(pick(states, (n + 1) % 6), n + 1_000_000_000))
        return once.unionByName(again)

    def subscriptions(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").filter(key % 7 != 0).select(
            key.alias("user_id"), F.concat(F.lit("cus_"), key.cast("string")).alias("stripe_customer_id"),
            F.lit(None).cast("string").alias("stripe_subscription_id"), F.lit("incomplete").alias("status"),
            F.lit(None).cast("string").alias("price_id"), F.lit(None).cast("timestamp_ntz").alias("current_period_end"),
        )

    def submissions(self) -> DataFrame:
        """events → JSON bodies with up to 129 findings; some fields are numbers, some bodies broken or over-long."""
        n = F.col("event_id")
        finding = lambda i: F.concat(
            F.lit('{"id":"f'), i.cast("string"), F.lit('","title":"t","severity":"'),
            F.when(i % 5 == 0, "HIGH").otherwise("LOW"), F.lit('","confidence":"definitive","asvsCategory":"SECRETS","file":'),
            F.when(i % 7 == 3, F.lit("7")).otherwise(F.lit('"a.ts"')), F.lit(',"line":'), i.cast("string"),
            F.lit(',"detail":"d","remediation":"r"}'),
        )
        many = n % 130 + 1
        # The texts of 1 to 130 are literals; numbers below 1 are spelt out as before.
        texts = F.array(*[F.lit(
            f'{{"id":"f{i}","title":"t","severity":"{"HIGH" if i % 5 == 0 else "LOW"}","confidence":"definitive","asvsCategory":"SECRETS","file":'
            + ("7" if i % 7 == 3 else '"a.ts"') + f',"line":{i},"detail":"d","remediation":"r"}}') for i in range(1, 131)])
        items = F.array_join(F.when(many < 1, F.transform(F.sequence(F.lit(1), many), finding)).otherwise(F.slice(texts, F.lit(1), many.cast("int"))), ",")
        body = F.concat(
            F.lit('{"repo":'), F.when(n % 3 == 0, F.lit("5")).otherwise(F.lit('"org/r"')), F.lit(',"ref":"main","findings":'),
            F.when(n % 17 == 0, F.lit("{}")).otherwise(F.concat(F.lit("["), items, F.lit("]"))), F.lit("}"),
        )
        padded = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"pad":"'), F.expr("repeat('x', 600000)"), F.lit('"}'))
        value = F.when(n % 997 == 5, padded).when(n % 19 == 0, F.lit("{broken")).otherwise(body)
        return spread_by_key(self.table("events"), "event_id").select(
            n.alias("submission_id"), F.col("user_id"), F.col("ts"), value.alias("value")
        )

    def archives(self) -> DataFrame:
        """documents → one small gzip tar per document: its file, an ignored one, a picture and an over-long name.

        By its number an archive may also be cut within the packed stream, cut within the tar, over-long, empty, no
        archive at all, or missing (``ARCHIVE_FAULTS``).
        """

        def pack(number, path, content):
            import gzip
            import io
            import tarfile

            fault = ARCHIVE_FAULTS.get(int(number) % 50)
            buffer = io.BytesIO()
            with tarfile.open(fileobj=buffer, mode="w") as archive:
                names = (path.replace("\\", "/"), "node_modules/x/" + path, "logo.png", "long/" + "d" * 120 + "/a.ts")
                for name in () if fault == "empty" else names:
                    data = b"\x89PNG\r\n\xff\x00" * 40 if name == "logo.png" else content.encode()
                    info = tarfile.TarInfo("wrapper-1/" + name)
                    info.size = len(data)
                    archive.addfile(info, io.BytesIO(data))
            plain = buffer.getvalue()
            if fault == "cut":
                # Up to the middle of the last member: the files before it are whole.
                plain = plain[:plain.rindex(b"wrapper-1/long/") // 512 * 512 + 700]
            elif fault == "too_large":
                plain += bytes(ARCHIVE_LIMIT)
            packed = gzip.compress(plain, 1)
            if fault == "broken":
                packed = packed[:len(packed) // 2]
            return None if fault == "missing" else b"no archive" if fault == "not_gzip" else packed

        files = self.files().select(
            F.concat("project_id", F.lit("-"), F.col("file_seq").cast("string")).alias("project_id"), "file_seq", "path", "content"
        )
        # Pickled a hundred rows at a time, so Python never holds an Arrow batch of texts with their archives.
        return files.select("project_id", F.udf(pack, "binary", useArrow=False)("file_seq", "path", "content").alias("archive"))
