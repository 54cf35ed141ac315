"""Queries through the edges: JSON event sources, a loaded control reference, sinks, codecs, an enricher of one's own."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from plumbline import fixed_values as fv
from plumbline.operators import billing as billing_ops, controls, enrichment as en, events as ev
from plumbline.plans import ORACLE, billing, events, findings, query
from plumbline.session import staging_folder
from plumbline.sources import events as source, sinks

_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _folder(t, name: str) -> str:
    return f"{staging_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("scan_requests_from_json", ORACLE["scan_requests"])
def _repo_events(t):
    folder = _folder(t, "repo-events")
    t.repo_events().select("seq", "event", "payload", "ts").write.option("timestampNTZFormat", _MICROS).json(folder)
    return ev.scan_requests(source.read_repo_events(t.spark, folder), t.installations()).select(*events._REQUEST_COLUMNS)


@query("event_ledger_from_json", ORACLE["event_ledger"])
def _billing_events(t):
    folder = _folder(t, "billing-events")
    t.billing_events().write.option("timestampNTZFormat", _MICROS).json(folder)
    return billing_ops.first_deliveries(source.read_billing_events(t.spark, folder)).select("id", "arrival_seq")


@query("enrichment_with_loaded_controls", ORACLE["default_enrichment"])
def _loaded_controls(t):
    folder = _folder(t, "controls")
    requirements = [dict(zip(controls.REQUIREMENT_COLUMNS, r)) for r in fv.REQUIREMENTS]
    document = {"version": "1", "categoryMap": {c: list(ids) for c, ids in fv.CATEGORY_REQUIREMENTS.items()}, "requirements": requirements}
    schema = "version string, categoryMap map<string,array<string>>, requirements array<struct<id:string,chapter:string,section:string,title:string,text:string>>"
    t.spark.createDataFrame([document], schema).coalesce(1).write.json(folder)
    analyzed = controls.default_enrichment(t.scan_findings(), controls.control_dims(t.spark, folder))
    return analyzed.select(
        "scan_id", "id", F.col("asvs_requirement.id").alias("req_id"), F.col("asvs_requirement.title").alias("req_title"),
        F.col("is_likely_real_issue").alias("likely"), "explanation", F.array_join("remediation_steps", "|").alias("steps"),
    )


@query(
    "scan_sink",
    f"""{findings._SF} SELECT CAST(date_trunc('month', created_at) AS DATE) AS scan_date, count(DISTINCT s.scan_id) AS scans, count(f.scan_id) AS findings,
    count(*) FILTER (f.severity = 'HIGH') AS high FROM scans s LEFT JOIN scan_findings f ON f.scan_id = s.scan_id GROUP BY 1""",
)
def _scan_sink(t):
    """Two batches, the second one written again as after a failure; folders by month."""
    folder = _folder(t, "scan-sink")
    scans = t.scans().withColumn("created_at", F.trunc("created_at", "month"))
    for batch in (0, 1, 1):
        mine = F.col("scan_id") % 2 == batch
        sinks.write_scans(scans.filter(mine), t.scan_findings().filter(mine), folder, batch)
    stored = sinks.committed(t.spark, folder, "scans").groupBy("scan_date").agg(F.count(F.lit(1)).alias("scans"))
    children = sinks.committed(t.spark, folder, "scan_findings").groupBy("scan_date").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity") == "HIGH").alias("high"))
    return stored.join(children, "scan_date", "left").fillna(0).select("scan_date", "scans", "findings", "high")


_STORED = ["id", "severity", "title", "file", "line", "detail", "code_snippet"]


@query("findings_codec", f"{findings._SF} SELECT scan_id, ord, {', '.join(_STORED)} FROM scan_findings WHERE ord % 7 <> 0")
def _codec(t):
    """Findings as stored JSON and back; a document without text reads as no findings."""
    finding = F.struct(*[F.col(c).cast("long").alias(c) if c == "line" else F.col(c) for c in _STORED])
    texts = sinks.findings_json(t.scan_findings().select("scan_id", "ord", finding.alias("finding")))
    stored = texts.select("scan_id", "ord", F.when(F.col("ord") % 7 != 0, F.concat(F.lit("["), "json", F.lit("]"))).alias("json"))
    schema = "struct<" + ",".join(f"{c}:{'bigint' if c == 'line' else 'string'}" for c in _STORED) + ">"
    return sinks.findings_from_json(stored, schema).select("scan_id", "ord", F.inline("findings"))


def _answers(batches):
    for batch in batches:
        some = batch[batch["ord"] % 3 == 0]
        yield pd.DataFrame({
            "scan_id": some["scan_id"], "id": some["id"], "ord": some["ord"], "likely": "high",
            "explanation": "model " + some["id"], "steps": [["a", "b"]] * len(some), "example": None,
        })


@query(
    "findings_from_enricher",
    f"""{billing._CACHE}, looked AS (SELECT k.*, c.cache_key IS NOT NULL AS cached FROM keyed k
      LEFT JOIN cache c ON c.cache_key = k.cache_key AND c.model = 'model-a'),
    answers AS (SELECT DISTINCT scan_id, id FROM looked WHERE NOT cached AND ord % 3 = 0)
    SELECT l.scan_id, l.id, detail, cached, NOT cached AND a.id IS NOT NULL AS answered,
      CASE WHEN cached THEN 'cached ' || cache_key WHEN a.id IS NOT NULL THEN 'model ' || l.id ELSE detail END AS explanation
    FROM looked l LEFT JOIN answers a ON a.scan_id = l.scan_id AND a.id = l.id""",
)
def _enricher(t):
    found = en.enrich(t.scan_findings(), billing._cache(t), "model-a", controls.control_dims(t.spark), _answers)
    return found.select("scan_id", "id", "detail", "cached", "answered", "explanation")
