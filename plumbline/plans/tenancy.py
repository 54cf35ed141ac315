"""Queries over keys, accounts, setups and providers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from plumbline import fixed_values as fv
from plumbline.functions import keys as k
from plumbline.operators import billing, events as ev, jobs as jb, setups as st, tenancy as tn
from plumbline.plans import oracle as o
from plumbline.plans import query

_NOW = "2024-02-01 00:00:00"


@query("authenticated_calls", f"WITH {o.USES} SELECT call_id, api_key_id, user_id FROM uses")
def _auth(t):
    return tn.resolve_keys(t.bearer_calls(), t.api_keys()).select("call_id", "api_key_id", "user_id")


@query(
    "keys_last_used",
    f"WITH {o.USES} SELECT id, max(ts) AS last_used_at FROM api_keys LEFT JOIN uses ON api_key_id = id GROUP BY id",
)
def _last_used(t):
    return tn.last_used(t.api_keys(), tn.resolve_keys(t.bearer_calls(), t.api_keys())).select("id", "last_used_at")


@query(
    "key_listing",
    f"WITH {o.API_KEYS} SELECT user_id, id, name, key_prefix, created_at, last_used_at, revoked_at FROM api_keys",
)
def _listing(t):
    return tn.newest_keys(t.api_keys())


@query(
    "revoked_keys",
    f"WITH {o.API_KEYS} SELECT id, CASE WHEN revoked_at IS NOT NULL THEN revoked_at WHEN user_id % 4 = 1 THEN TIMESTAMP '{_NOW}' END AS revoked_at FROM api_keys",
)
def _revoked(t):
    key = F.col("c_custkey")
    asked = t.table("customer").filter(key % 4 < 2).select(
        (key + F.when(key % 4 == 0, 1).otherwise(0)).alias("user_id"), F.concat(F.lit("k"), key.cast("string")).alias("id")
    )
    return tn.revoke(t.api_keys(), asked, _NOW).select("id", "revoked_at")


# The nine tables that hang on a user and two shared ones, each with the key of its rows.
_OWNED = {
    "accounts": "SELECT c_custkey AS user_id, c_name AS key FROM customer",
    "sessions": "SELECT user_id, CAST(event_id AS VARCHAR) AS key FROM events",
    "subscriptions": "SELECT c_custkey AS user_id, 'cus_' || c_custkey AS key FROM customer WHERE c_custkey % 7 <> 0",
    "api_keys": "SELECT user_id, id AS key FROM api_keys",
    "scans": "SELECT user_id, CAST(scan_id AS VARCHAR) AS key FROM scans",
    "installations": "SELECT user_id, CAST(installation_id AS VARCHAR) AS key FROM installations",
    "repo_setups": "SELECT user_id, api_key_id AS key FROM repo_setups",
    "jobs": "SELECT user_id, CAST(seq AS VARCHAR) AS key FROM requests QUALIFY row_number() OVER (PARTITION BY repo_id, head_sha ORDER BY seq) = 1",
    "provider_connections": "SELECT c_custkey AS user_id, c_mktsegment || c_custkey AS key FROM customer WHERE c_custkey % 4 = 0",
}
_SHARED = {"rate_limits": "SELECT CAST(event_id AS VARCHAR) AS key FROM events", "event_ledger": "SELECT DISTINCT 'evt_' || event_id AS key FROM events"}


@query(
    "purged_tables",
    f"WITH {o.SCANS}, {o.API_KEYS}, {o.SETUPS}, {o.REQUESTS} "
    + " UNION ALL ".join(f"SELECT '{name}' AS name, key FROM ({rows}) WHERE user_id % 8 <> 3" for name, rows in _OWNED.items())
    + "".join(f" UNION ALL SELECT '{name}', key FROM ({rows})" for name, rows in _SHARED.items()),
)
def _purged(t):
    """Row for row: what is left of each table once every eighth user is gone."""
    customer, events = t.table("customer"), t.table("events")
    key, text = F.col("c_custkey"), lambda c: F.col(c).cast("string").alias("key")
    requests = ev.scan_requests(t.repo_events(), t.installations())
    tables = {
        "accounts": customer.select(key.alias("user_id"), F.col("c_name").alias("key")),
        "sessions": events.select("user_id", text("event_id")),
        "subscriptions": t.subscriptions().select("user_id", F.col("stripe_customer_id").alias("key")),
        "api_keys": t.api_keys().select("user_id", F.col("id").alias("key")),
        "scans": t.scans().select("user_id", text("scan_id")),
        "installations": t.installations().select("user_id", text("installation_id")),
        "repo_setups": t.repo_setups().select("user_id", F.col("api_key_id").alias("key")),
        "jobs": jb.jobs_from_events(requests).select("user_id", text("seq")),
        "provider_connections": customer.filter(key % 4 == 0).select(
            key.alias("user_id"), F.concat("c_mktsegment", key.cast("string")).alias("key")),
        "rate_limits": events.select("user_id", text("event_id")),
        "event_ledger": billing.first_deliveries(t.billing_events()).select(F.lit(3).cast("long").alias("user_id"), F.col("id").alias("key")),
    }
    ids = customer.select(F.explode(F.array(key, key + 1_000_000)).alias("user_id"))
    left = tn.purge(tables, ids.filter(F.col("user_id") % 8 == 3))
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("name"), "key") for name, rows in left.items()])


@query(
    "scans_with_missing_keys_nulled",
    f"WITH {o.SCANS} SELECT scan_id, CASE WHEN user_id % 20 <> 0 THEN api_key_id END AS api_key_id FROM scans",
)
def _nulled(t):
    key = F.col("c_custkey")
    kept = t.table("customer").filter(key % 20 != 0).select(F.concat(F.lit("key"), key.cast("string")).alias("id"))
    return tn.null_missing_keys(t.scans(), kept).select("scan_id", "api_key_id")


@query(
    "owned_requests",
    f"""WITH {o.INSTALLATIONS} SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM installations i
    WHERE i.installation_id = e.user_id AND i.user_id = e.user_id + 1000000 + (e.event_id % 3 = 0)::INT)""",
)
def _owned(t):
    n = F.col("event_id")
    asked = t.table("events").select(
        n, F.col("user_id").alias("installation_id"), (F.col("user_id") + 1000000 + F.when(n % 3 == 0, 1).otherwise(0)).alias("user_id")
    )
    return tn.owned(asked, t.installations()).select("event_id")


@query(
    "connected_requests",
    f"""WITH {o.SETUPS} SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM repo_setups s WHERE s.user_id = e.user_id + 1000000
    AND s.repo_full_name = 'org' || (e.user_id % 20) || '/r' || (e.event_id % 3))""",
)
def _connected(t):
    asked = t.table("events").select(
        "event_id", (F.col("user_id") + 1000000).alias("user_id"),
        F.concat(F.lit("org"), (F.col("user_id") % 20).cast("string"), F.lit("/r"), (F.col("event_id") % 3).cast("string")).alias("repo_full_name"),
    )
    return tn.connected(asked, t.repo_setups()).select("event_id")


@query(
    "repos_without_setup",
    f"""WITH {o.SETUPS} SELECT c_custkey + 1000000 AS user_id, 'org' || (c_custkey % 20) || '/r0' AS repo_full_name FROM customer c
    WHERE NOT EXISTS (SELECT 1 FROM repo_setups s WHERE s.user_id = c_custkey + 1000000 AND s.repo_full_name = 'org' || (c_custkey % 20) || '/r0')""",
)
def _without_setup(t):
    key = F.col("c_custkey")
    repos = t.table("customer").select(
        (key + 1000000).alias("user_id"), F.concat(F.lit("org"), (key % 20).cast("string"), F.lit("/r0")).alias("repo_full_name")
    )
    return tn.without_setup(repos, t.repo_setups())


@query(
    "duplicate_key_audit",
    "SELECT o_custkey, o_orderdate, count(*) AS rows FROM orders GROUP BY ALL HAVING count(*) > 1",
)
def _audit(t):
    return tn.duplicate_keys(t.table("orders"), ["o_custkey", "o_orderdate"])


@query(
    "connected_installations",
    f"WITH {o.INSTALLATIONS} SELECT installation_id, account_login, account_type, user_id, suspended_at IS NOT NULL AS suspended FROM installations",
)
def _installations(t):
    return tn.connected_installations(t.installations())


# ---- setups ----------------------------------------------------------------------------------
_PROVIDERS = "providers(provider, label, mechanism, link, instructions) AS (VALUES " + ", ".join(
    f"({o.lit(p)}, {o.lit(label)}, {o.lit(m)}, {o.lit(link)}, {o.lit('|'.join(texts))})" for p, label, m, link, texts in fv.PROVIDERS
) + ")"


@query(
    "provider_descriptors",
    f"""WITH {o.SETUPS}, {_PROVIDERS} SELECT s.user_id, s.repo_full_name, p.provider, label, mechanism,
    replace(link, '{{repo}}', repo_full_name) AS settings_url,
    replace(replace(instructions, '{{branch}}', coalesce(default_branch, 'your production branch')), '{{check}}', '{fv.CHECK_NAME}') AS instructions
    FROM repo_setups s JOIN providers p ON p.provider = CASE WHEN gate_provider = 'gone' THEN 'vercel' ELSE gate_provider END""",
)
def _descriptors(t):
    described = st.with_provider(t.repo_setups(), st.provider_dim(t.spark))
    return described.select(
        "user_id", "repo_full_name", "provider", "label", "mechanism", "settings_url",
        F.array_join("instructions", "|").alias("instructions"),
    )


_ACTION, _SECRET = "example/action@v1", "SCAN_KEY"
_WORKFLOWS = st.workflow_texts(_ACTION, _SECRET)


@query(
    "desired_configs",
    f"""WITH {o.SETUPS} SELECT user_id, repo_full_name, md5(CASE WHEN gate_provider IN ('netlify', 'cloudflare') THEN
    replace({o.lit(_WORKFLOWS[1])}, '{{branch}}', coalesce(default_branch, 'main')) ELSE {o.lit(_WORKFLOWS[0])} END) AS digest FROM repo_setups""",
)
def _desired(t):
    described = st.with_provider(t.repo_setups(), st.provider_dim(t.spark))
    text = st.desired_config(F.col("mechanism"), F.col("default_branch"), *_WORKFLOWS)
    return described.select("user_id", "repo_full_name", F.md5(text).alias("digest"))


@query(
    "config_drift",
    """SELECT 'r' || s_suppkey AS repo_full_name, CASE s_suppkey % 4 WHEN 0 THEN 'created' WHEN 3 THEN 'drift' ELSE 'unchanged' END AS state
    FROM supplier""",
)
def _drift(t):
    key = F.col("s_suppkey")
    name = F.concat(F.lit("r"), key.cast("string")).alias("repo_full_name")
    desired = t.table("supplier").select(name, F.concat(F.lit("text "), F.col("s_name"), F.lit("\n")).alias("desired"))
    seen = F.when(key % 4 == 1, F.concat(F.lit("text "), F.col("s_name"))).when(
        key % 4 == 2, F.concat(F.lit("text "), F.col("s_name"), F.lit(" \n\n\t"))
    ).otherwise("other")
    observed = t.table("supplier").filter(key % 4 != 0).select(name, seen.alias("content"))
    return st.config_drift(observed, desired)


def _runs(t):
    n, user = F.col("event_id"), F.col("user_id")
    providers = F.array(*map(F.lit, ["vercel", "netlify", "cloudflare"]))
    return t.table("events").filter(F.col("event_type") == "signup").select(
        (user + 1000000).alias("user_id"),
        F.concat(F.lit("org"), (user % 20).cast("string"), F.lit("/r"), (user % 3).cast("string")).alias("repo_full_name"),
        n.alias("seq"), user.alias("installation_id"), F.lit("main").alias("default_branch"),
        F.when(n % 4 == 0, "pending").otherwise("updated").alias("workflow_state"),
        F.when(n % 3 == 0, "pending").otherwise("set").alias("secret_state"), F.lit("kx").alias("api_key_id"),
        F.element_at(providers, (F.floor(user / 2) % 3 + F.when(n % 500 == 7, 1).otherwise(0)).cast("int") % 3 + 1).alias("gate_provider"),
        F.when(n % 4 == 0, "boom").alias("error"),
    )


@query(
    "setup_upserts",
    f"""WITH {o.SETUPS}, runs AS (SELECT user_id + 1000000 AS user_id, 'org' || (user_id % 20) || '/r' || (user_id % 3) AS repo_full_name, event_id AS seq,
      CASE WHEN event_id % 4 = 0 THEN 'error' ELSE 'updated' END AS workflow_state,
      CASE WHEN event_id % 3 <> 0 THEN 'set' WHEN event_id % 4 = 0 THEN 'error' ELSE 'pending' END AS secret_state,
      ['vercel', 'netlify', 'cloudflare'][CAST(((user_id // 2) % 3 + (event_id % 500 = 7)::INT) % 3 AS INT) + 1] AS gate_provider,
      CASE WHEN event_id % 4 = 0 THEN 'boom' END AS last_error FROM events WHERE event_type = 'signup'),
    steps AS (SELECT user_id, repo_full_name, -1 AS seq, gate_provider FROM repo_setups UNION ALL SELECT user_id, repo_full_name, seq, gate_provider FROM runs),
    chg AS (SELECT user_id, repo_full_name, bool_or(c) AS changed FROM (SELECT *, gate_provider <> lag(gate_provider) OVER (PARTITION BY user_id, repo_full_name ORDER BY seq) AS c FROM steps) GROUP BY ALL),
    lastrun AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY user_id, repo_full_name ORDER BY seq DESC) = 1)
    SELECT coalesce(s.user_id, r.user_id) AS user_id, coalesce(s.repo_full_name, r.repo_full_name) AS repo_full_name,
      coalesce(r.workflow_state, s.workflow_state) AS workflow_state, coalesce(r.secret_state, s.secret_state) AS secret_state,
      coalesce(r.gate_provider, s.gate_provider) AS gate_provider, r.last_error,
      CASE WHEN s.user_id IS NULL OR (r.user_id IS NOT NULL AND changed) THEN 'unverified' ELSE s.gate_state END AS gate_state,
      CASE WHEN s.user_id IS NULL OR (r.user_id IS NOT NULL AND changed) THEN NULL ELSE s.gate_last_checked_at END AS gate_last_checked_at
    FROM repo_setups s FULL JOIN lastrun r ON r.user_id = s.user_id AND r.repo_full_name = s.repo_full_name
    LEFT JOIN chg c ON c.user_id = coalesce(s.user_id, r.user_id) AND c.repo_full_name = coalesce(s.repo_full_name, r.repo_full_name)""",
)
def _setup_upserts(t):
    return st.apply_setup_events(t.repo_setups(), _runs(t)).select(
        "user_id", "repo_full_name", "workflow_state", "secret_state", "gate_provider", "last_error", "gate_state",
        "gate_last_checked_at",
    )


_MARKS = """marks AS (SELECT user_id + 1000000 AS user_id, 'org' || (user_id % 20) || '/r' || (user_id % 3) AS repo_full_name, ts, event_id
  FROM events WHERE event_type = 'purchase' AND event_id % 7 = 0)"""


def _marks(t):
    user = F.col("user_id")
    return t.table("events").filter((F.col("event_type") == "purchase") & (F.col("event_id") % 7 == 0)).select(
        (user + 1000000).alias("user_id"),
        F.concat(F.lit("org"), (user % 20).cast("string"), F.lit("/r"), (user % 3).cast("string")).alias("repo_full_name"),
        "ts", F.when(F.col("event_id") % 4 == 0, "required").otherwise("error").alias("state"),
    )


@query(
    "attested_gates",
    f"""WITH {o.SETUPS}, {_MARKS}, m AS (SELECT user_id, repo_full_name, max(ts) AS seen_at FROM marks GROUP BY ALL)
    SELECT s.user_id, s.repo_full_name, CASE WHEN seen_at IS NOT NULL THEN 'required' ELSE gate_state END AS gate_state,
      coalesce(seen_at, gate_last_checked_at) AS gate_last_checked_at FROM repo_setups s LEFT JOIN m USING (user_id, repo_full_name)""",
)
def _attested(t):
    return st.attest(t.repo_setups(), _marks(t)).select("user_id", "repo_full_name", "gate_state", "gate_last_checked_at")


@query(
    "rechecked_gates",
    f"""WITH {o.SETUPS}, {_MARKS}, m AS (SELECT user_id, repo_full_name, max(ts) AS seen_at, bool_or(event_id % 4 = 0) AS up FROM marks GROUP BY ALL)
    SELECT s.user_id, s.repo_full_name, CASE WHEN up THEN 'required' ELSE gate_state END AS gate_state,
      coalesce(seen_at, gate_last_checked_at) AS gate_last_checked_at FROM repo_setups s LEFT JOIN m USING (user_id, repo_full_name)""",
)
def _rechecked(t):
    return st.apply_recheck(t.repo_setups(), _marks(t)).select(
        "user_id", "repo_full_name", "gate_state", "gate_last_checked_at"
    )


@query(
    "gates_due_for_recheck",
    f"""WITH {o.SETUPS} SELECT user_id, repo_full_name FROM repo_setups WHERE gate_provider = 'vercel' AND gate_state <> 'required'
    AND (gate_last_checked_at IS NULL OR gate_last_checked_at <= TIMESTAMP '2024-01-10 00:05:00') AND user_id % 2 = 1""",
)
def _due(t):
    connections = t.table("customer").filter(F.col("c_custkey") % 2 == 1).select((F.col("c_custkey") + 1000000).alias("user_id"))
    return st.due_for_recheck(t.repo_setups(), connections, "2024-01-10 00:10:00").select("user_id", "repo_full_name")


@query(
    "scalar_functions",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso,
    (epoch_us(ts) // 1000) // 60000 AS window_index, ((epoch_us(ts) // 1000) // 60000 + 1) * 60000 AS window_end,
    CAST(ceil((((epoch_us(ts) // 1000) // 60000 + 1) * 60000 - (epoch_us(ts) // 1000)) / 1000.0) AS BIGINT) AS retry_sec,
    substr('pflt_token' || event_id, 1, 13) AS prefix, sha256('pflt_token' || event_id) AS hash,
    CASE WHEN event_id % 3 <> 0 THEN 'pflt_token' || event_id END AS bearer FROM events""",
)
def _scalars(t):
    ts, n = F.col("ts"), F.col("event_id").cast("string")
    token = F.concat(F.lit("pflt_token"), n)
    header = F.concat(F.when(F.col("event_id") % 3 == 0, "Basic ").otherwise("Bearer "), token)
    return t.table("events").select(
        "event_id", k.iso_time(ts).alias("iso"), k.window_index(ts, 60).alias("window_index"),
        k.window_end_millis(ts, 60).alias("window_end"), k.retry_seconds(ts, 60).alias("retry_sec"),
        k.token_prefix(token).alias("prefix"), k.token_hash(token).alias("hash"), k.bearer_token(header).alias("bearer"),
    )


@query(
    "unique_key_audits",
    f"""WITH {o.REQUESTS}, {o.SETUPS}, {o.API_KEYS}, d AS (
      SELECT 'jobs' AS name, count(*) AS rows FROM requests GROUP BY repo_id, head_sha HAVING count(*) > 1
      UNION ALL SELECT 'repo_setups', count(*) FROM repo_setups GROUP BY user_id, repo_full_name HAVING count(*) > 1
      UNION ALL SELECT 'installations', count(*) FROM installations GROUP BY installation_id HAVING count(*) > 1
      UNION ALL SELECT 'api_keys', count(*) FROM api_keys GROUP BY token HAVING count(*) > 1)
    SELECT n.name, count(d.rows) AS duplicated_keys, CAST(coalesce(sum(d.rows), 0) AS BIGINT) AS rows
    FROM (VALUES ('jobs'), ('repo_setups'), ('installations'), ('api_keys')) n(name) LEFT JOIN d ON d.name = n.name GROUP BY n.name""",
)
def _unique_keys(t):
    from plumbline.operators.events import scan_requests

    audited = {
        "jobs": (scan_requests(t.repo_events(), t.installations()), ["repo_id", "head_sha"]),
        "repo_setups": (t.repo_setups(), ["user_id", "repo_full_name"]),
        "installations": (t.installations(), ["installation_id"]),
        "api_keys": (t.api_keys(), ["key_hash"]),
    }
    counts = [
        tn.duplicate_keys(df, keys)
        .agg(F.count(F.lit(1)).alias("duplicated_keys"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
        .select(F.lit(name).alias("name"), "duplicated_keys", "rows")
        for name, (df, keys) in audited.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])
