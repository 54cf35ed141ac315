"""Queries of this subpackage. Each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from plumbline.llm import bpe
from plumbline.llm.decontaminate import contamination
from plumbline.llm.frames import read_table, staging_folder
from plumbline.llm import ann, divergence, hard_negatives, licenses, oracles, pii, secrets, url_filter
from plumbline.llm.html_extract import extract
from plumbline.llm.near_dedup import near_duplicates
from plumbline.llm.substring_dedup import drop_repeated
from plumbline.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(plan):
    QUERIES[plan.__name__] = plan
    return plan


@query
def op1_decontamination(spark, sf_dir):
    found, _ = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE["op1_decontamination"] = oracles.DECONTAMINATION


@query
def op8_html(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))


@query
def op9_near_dedup(spark, sf_dir):
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


ORACLE["op9_near_dedup"] = oracles.NEAR_DUPLICATES


@query
def op2_substring_dedup(spark, sf_dir):
    return drop_repeated(read_table(spark, sf_dir, "documents"), texts=False).withColumnRenamed("id", "doc_id")


@query
def op3_neighbours(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


@query
def op4_pii(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, key="corpus-key-1")


@query
def op5_bpe(spark, sf_dir):
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = bpe.digests(read_table(spark, sf_dir, "documents"), tokens, public_tokenizers.PATTERN)
    return found.withColumnRenamed("id", "doc_id")


@query
def op7_toxicity(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    found = toxicity(read_table(spark, sf_dir, "documents"), labels.where(remainder != 0))
    return found.select(
        F.col("id").alias("doc_id"), F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op6_secrets(spark, sf_dir):
    # Each run of the query starts with an empty ledger; a job that runs again keeps its folder.
    ledger = secrets.Ledger(spark, f"{staging_folder(spark)}/ledger-{uuid.uuid4().hex}")
    found = secrets.spans_of(read_table(spark, sf_dir, "documents"), ledger, keep=["doc_id"])
    told = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["rank"] < len(secrets.BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secrets.BASE], F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("found")).alias("spans"))


ORACLE["op6_secrets"] = oracles.secrets_oracle()


@query
def op10_licenses(spark, sf_dir):
    found = licenses.licences(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("licences", ",").alias("licences"))


ORACLE["op10_licenses"] = licenses.oracle()


@query
def op11_divergence(spark, sf_dir):
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


ORACLE["op11_divergence"] = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 10),
vocab AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
sides AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
lang_counts AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL),
lang_sums AS (SELECT lang, sum(n) AS total FROM counts GROUP BY ALL),
shares AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * v.v) AS p
  FROM sides s JOIN kept k USING (lang) JOIN vocab v USING (lang) LEFT JOIN sums t USING (lang, source)
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
lang_shares AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (total + 2 * v) AS q
  FROM lang_counts JOIN lang_sums USING (lang) JOIN vocab USING (lang)),
pair_sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM sides a JOIN sides b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_sums p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM shares JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

#: Rules of op12 (host, path, verdict), as dealt.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


@query
def op12_url_filter(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    told = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("host", "path", "verdict"), rule)]) for rule in URL_RULES])
    rules = spark.range(1).select(F.inline(told))
    return url_filter.build_filter(rules, pages).judge(pages)


ORACLE["op12_url_filter"] = r"""
WITH parts AS (SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS r FROM pages),
rules(h, p, v) AS (VALUES """ + ", ".join(map(str, URL_RULES)) + r"""),
fits AS (SELECT r, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (r)
"""


@query
def op13_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read_table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


ORACLE["op13_hard_negatives"] = """
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0 AND len(a.v) = len(b.v)),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM met WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN met USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 3
"""
