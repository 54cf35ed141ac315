"""Golden projects: one that trips every rule, one that trips none."""

import pytest

from plumbline import fixed_values as fv
from plumbline.operators.rules import Rule, every_match
from plumbline.operators.scan import FINDING_COLUMNS, scan_projects, scanned_counts

# Token-shaped values are put together here so that no stored text looks like a credential.
AWS = "AKIA" + "IOSFODNN7EXAMPLE"
GITHUB = "ghp" + "_" + "A" * 36
STRIPE = "sk" + "_live_" + "0" * 24
SLACK = "xox" + "b-" + "0" * 20
PEM = "-----BEGIN RSA " + "PRIVATE" + " KEY-----"

OPEN_PROJECT = {
    "lib/config.ts": (
        "export const anon = process.env.NEXT_PUBLIC_SUPABASE_ANON_KEY;\n"
        "export const role = process.env.NEXT_PUBLIC_SERVICE_ROLE_KEY;\n"
        "export const stats = process.env.NEXT_PUBLIC_ANALYTICS_TOKEN;\n"
        "export const url = 'postgres://app:" + "s3cretpw" + "@db.example.com:5432/app';\n"
    ),
    "app/admin/panel.tsx": (
        "'use client';\nimport { createClient } from 'x';\n"
        "// service_role in the browser\nexport const admin = createClient(u, 'service_role');\n"
    ),
    "app/api/users/route.ts": (
        "import { supabase } from '@/lib/db';\nexport async function GET() {\n"
        "  return Response.json(await supabase.from('users').select('*'));\n}\n"
    ),
    "app/actions/save.ts": "'use server';\nexport async function save(r) {\n  await supabase.from('p').insert(r);\n}\n",
    "db/schema.sql": (
        "create table profiles (id uuid primary key);\n\n"
        "create table public.posts (id uuid primary key);\n"
        "alter table public.posts enable row level security;\n"
        "create policy posts_all on public.posts for select using (true);\n"
    ),
    "lib/db.ts": (
        "import { Pool } from 'pg';\nexport const pool = new Pool();\nexport async function byId(id) {\n"
        "  return pool.query(`select * from users where id = ${id}`);\n}\n"
    ),
    "lib/dyn.ts": "export function run(x) {\n  return eval(x);\n}\n",
    "components/Post.tsx": (
        "export function Post({ post }) {\n  return <div dangerouslySetInnerHTML={{ __html: post.body }} />;\n}\n"
    ),
    "next.config.js": "const nextConfig = {};\nmodule.exports = nextConfig;\n",
    "lib/secrets.ts": (
        f"export const a = '{AWS}';\nexport const b = '{GITHUB}';\nexport const c = '{STRIPE}';\n"
        f"export const d = '{SLACK}';\nexport const e = `{PEM}`;\n"
    ),
}
CLOSED_PROJECT = {
    "lib/config.ts": "export const r = process.env.SERVICE_ROLE_KEY;\nexport const a = process.env.NEXT_PUBLIC_ANON_KEY;\n",
    "app/api/users/route.ts": "const u = await supabase.auth.getUser();\nawait supabase.from('users').select('*');\n",
    "db/schema.sql": (
        "create table profiles (id uuid);\nalter table profiles enable row level security;\n"
        "create policy p on profiles for select using (auth.uid() = user_id);\n"
    ),
    "next.config.js": "module.exports = { async headers() { return [{ key: 'Content-Security-Policy' }]; } };\n",
    "lib/db.ts": "export const q = (id) => sql`select * from users where id = ${id}`;\n",
    "components/Post.tsx": "<div dangerouslySetInnerHTML={{ __html: DOMPurify.sanitize(post.body) }} />\n",
}
EXPECTED = [
    ("HIGH", "lib/config.ts", 2, "pf_28f10d54b767"),
    ("MEDIUM", "lib/config.ts", 3, "pf_2490a0e10613"),
    ("HIGH", "lib/config.ts", 4, "pf_045da9d3abee"),
    ("HIGH", "app/admin/panel.tsx", 3, "pf_bc5085bff106"),
    ("HIGH", "db/schema.sql", 5, "pf_c29d8744acc6"),
    ("HIGH", "db/schema.sql", 1, "pf_9a57f7969b71"),
    ("MEDIUM", "app/api/users/route.ts", 1, "pf_7669e996f3e5"),
    ("MEDIUM", "app/actions/save.ts", 1, "pf_c711a488be4b"),
    ("LOW", "next.config.js", 1, "pf_667c38c09238"),
    ("HIGH", "lib/secrets.ts", 1, "pf_d12feb51ea91"),
    ("HIGH", "lib/secrets.ts", 2, "pf_98844fdbc1e0"),
    ("HIGH", "lib/secrets.ts", 3, "pf_a9393774e2f4"),
    ("HIGH", "lib/secrets.ts", 4, "pf_6c93ef4cc593"),
    ("HIGH", "lib/secrets.ts", 5, "pf_2cd1c0fef8ec"),
    ("MEDIUM", "lib/db.ts", 4, "pf_667ccaa5880c"),
    ("MEDIUM", "lib/dyn.ts", 2, "pf_40b271a74e28"),
    ("MEDIUM", "components/Post.tsx", 2, "pf_3ec6db7f87d1"),
]


def files_frame(spark, **projects):
    rows = [
        (name, seq, path, content)
        for name, files in projects.items()
        for seq, (path, content) in enumerate(files.items())
    ]
    return spark.createDataFrame(rows, "project_id string, file_seq int, path string, content string")


SQL = ("db/a.sql", "select 1;")
BAD = "eval(x)"
URL = "postgresql://u:{}@{}/d\n"
URLS = "".join(
    URL.format(p, h)
    for p, h in [("<password>", "db.x"), ("[pw]", "db.x"), ("changeme", "db.x"), ("xxxx", "db.x"),
                 ("real", "localhost"), ("real", "127.0.0.1:5432"), ("postgres", "db.x")]
)
BODY = "import x\n  'use server'\ndb.select()"
ROUTE = ("app/x/route.ts", "prisma.user.findMany()")
HTML = (
    "a\n<p dangerouslySetInnerHTML={{\n __html:\n body\n }} /> "
    "<p dangerouslySetInnerHTML={{ __html: 'x' }} />"
)
# case -> (files, expected (rule, file, line) in rule order)
CASES = {
    "no_sql": ([("lib/a.ts", "x")], [("B0", "(project)", None)]),
    "one_line_twice": ([SQL, ("lib/a.ts", "\neval(a); eval(b)")], [("G", "lib/a.ts", 2)] * 2),
    "one_line_two_tokens": ([SQL, ("lib/a.ts", f"{AWS} {GITHUB}")], [("E1", "lib/a.ts", 1)] * 2),
    "bom": ([SQL, ("lib/a.tsx", "\ufeff'use client'\n service_role")], [("A2", "lib/a.tsx", 2)]),
    "nbsp": ([SQL, ("lib/a.tsx", "\u00a0'use client'\n service_role")], [("A2", "lib/a.tsx", 2)]),
    "letter_before": ([SQL, ("lib/a.ts", "éeval(x)")], [("G", "lib/a.ts", 1)]),
    "word_before": ([SQL, ("lib/a.ts", "_eval(x) myeval(x)")], []),
    "lines": (
        [SQL, ("lib/a.ts", "a\n\nb.query(\n\n  `select ${x}`)\nc.raw('x' +\n y)")],
        [("F", "lib/a.ts", 3), ("F", "lib/a.ts", 6)],
    ),
    "html": ([SQL, ("lib/a.tsx", HTML)], [("H", "lib/a.tsx", 2)]),
    "urls": ([SQL, ("lib/a.ts", URLS)], [("A3", "lib/a.ts", 7)]),
    "names": (
        [SQL, ("lib/a.ts", "process.env.NEXT_PUBLIC_CANONICAL_SECRET\nprocess.env.NEXT_PUBLIC_KEYS\n"
                           "process.env.NEXT_PUBLIC_A_KEY")],
        [("A1B", "lib/a.ts", 3)],
    ),
    "secured_elsewhere": (
        [("a.sql", "create table T1 (x int)"), ("b.sql", "ALTER TABLE t1 ENABLE ROW LEVEL SECURITY")], []
    ),
    "created_twice": (
        [("a.sql", "\ncreate table if not exists t (x int)"), ("b.sql", "create table public.t (x int)")],
        [("B1", "a.sql", 2)],
    ),
    "quoted_schema": ([("a.sql", 'create table "public"."orders" (x int)')], [("B1", "a.sql", 1)]),
    "sql_order": (
        [("a.sql", "create table z (x int);\ncreate table a (x int);\nusing (true)"), ("b.sql", "using(true)")],
        [("B2", "a.sql", 3), ("B2", "b.sql", 1), ("B1", "a.sql", 1), ("B1", "a.sql", 2)],
    ),
    "first_config_open": (
        [SQL, ("next.config.js", ""), ("web/next.config.ts", "headers() {}")], [("D", "next.config.js", 1)]
    ),
    "first_config_set": ([SQL, ("next.config.js", "headers() {}"), ("web/next.config.ts", "")], []),
    "plain": ([SQL, ROUTE], [("C", "app/x/route.ts", 1)]),
    "guarded": ([SQL, ROUTE, ("src/middleware.ts", "requireAuth(req)")], [("C", "app/x/route.ts", 1)]),
    "kinds": (
        [SQL, ("app/route.js", BODY), ("pages/api/a.ts", BODY), ("lib/a.ts", BODY)],
        [("C", "app/route.js", 1), ("C", "pages/api/a.ts", 1), ("C", "lib/a.ts", 1)],
    ),
    "bare_auth": ([SQL, ("lib/a.ts", "'use server'\n auth(); db.select()")], [("C", "lib/a.ts", 1)]),
    "ignored": ([SQL, *[(p, BAD) for p in ["node_modules/a.ts", "x/build", "a.TS", ".env", "src/out/a.js"]]], []),
    "separators": ([SQL, (".\\lib\\a.ts", BAD)], [("G", "lib/a.ts", 1)]),
    "examples": (
        [SQL, ("lib/tokens.example.ts", AWS), ("mocks/a.ts", PEM), ("lib/b.ts", AWS)], [("E1", "lib/b.ts", 1)]
    ),
    "open": (list(OPEN_PROJECT.items()), None),
    "closed": (list(CLOSED_PROJECT.items()), []),
}


@pytest.fixture(scope="module")
def found(spark):
    files = files_frame(spark, **{name: dict(files) for name, (files, _) in CASES.items()})
    rows = scan_projects(files).orderBy("project_id", "check_no", "phase", "file_seq", "step", "pos").collect()
    return {name: [r for r in rows if r.project_id == name] for name in CASES}


@pytest.mark.parametrize("name", [n for n in CASES if n != "open"])
def test_case(found, name):
    assert [(r.rule, r.file, r.line) for r in found[name]] == CASES[name][1]


def test_open_project_in_rule_order(found):
    assert [(f.severity, f.file, f.line, f.id) for f in found["open"]] == EXPECTED


def test_shared_ids_keep_their_rows(found):
    for name in ("one_line_twice", "one_line_two_tokens"):
        assert found[name][0].id == found[name][1].id
    assert found["one_line_two_tokens"][0].detail != found["one_line_two_tokens"][1].detail


def test_texts(found):
    assert found["quoted_schema"][0].title == 'Table "public" has no RLS enabled in migrations'
    assert found["guarded"][0].detail == found["plain"][0].detail + fv.MIDDLEWARE_CAVEAT
    assert found["guarded"][0].id == found["plain"][0].id
    assert [r.title.split(" performs")[0] for r in found["kinds"]] == fv.ENTRY_POINT_KINDS


def test_counts_and_columns(spark):
    files = files_frame(spark, open=OPEN_PROJECT, closed=CLOSED_PROJECT)
    counts = {r.project_id: (r.files, r.code, r.sql) for r in scanned_counts(files).collect()}
    assert counts == {"open": (10, 9, 1), "closed": (6, 5, 1)}
    assert scan_projects(files).columns[: len(FINDING_COLUMNS)] == FINDING_COLUMNS


def test_user_rule(spark):
    rule = Rule(
        "todo", "code", every_match("X1", 9, r"TODO"),
        texts=(("X1", ("LOW", "CONFIG", "heuristic", "Open task", "detail", "fix")),),
    )
    rows = scan_projects(files_frame(spark, p={"a.ts": "a\nTODO"}), [rule]).collect()
    assert [(r.title, r.line) for r in rows] == [("Open task", 2)]
