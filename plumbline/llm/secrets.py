"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every file is content-addressed (SHA-256 of its text). The ledger says which (blob, rule
version) pairs have been scanned; only unseen pairs are scanned, once per distinct content however many paths
or versions hold it, and findings are joined back to all of them. Findings carry the batch that wrote them and
count only when that batch is in the ledger, so a batch that broke off half-way is scanned again without doubles.

Positions are code points, end exclusive. Matches of one kind are leftmost and do not overlap. Splitting a text
at a pattern gives the stretches between its matches; their lengths and those of the matches, summed up, are
the positions.

Defined results: null counts as empty and has no findings; repeated rows each get all findings of their blob;
other columns stay as they are; an empty table gives an empty result and leaves the ledger as it is.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.frames import spare_name, stage

RULE_VERSION = "1"


@dataclass(frozen=True)
class Rule:
    """``gate`` is a plain string that every match holds (in lower case), or a list of which it holds one."""

    kind: str
    pattern: str
    gate: tuple[str, ...]
    value_group: int = 0
    least: int = 0


#: The first three are the base kinds, in their order of precedence; the others add spans.
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         ("password", "passwd", "secret", "token", "apikey", "api_key"), 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", ("akia",), 0, 16),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", (), 0, 32),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", ("private key-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",)),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
]
BASE = ("assign", "access", "hex")


def _matches(rule: Rule, order: int, text: Column, lower: Column) -> Column:
    """One struct per match: its kind, number, the stretch before it, its length and whether it counts."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = whole if not rule.value_group else F.regexp_extract_all(text, pattern, F.lit(rule.value_group))
    found = F.transform(
        F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value")),
        lambda m, i: F.struct(
            F.lit(order).alias("rank"), i.alias("i"), F.length(m["gap"]).alias("gap"), F.length(m["whole"]).alias("len"),
            (F.length(m["value"]) >= rule.least).alias("ok")))
    none = F.array().cast("array<struct<rank:int,i:int,gap:int,len:int,ok:boolean>>")
    if rule.gate:
        gate = F.lit(False)
        for word in rule.gate:
            gate = gate | F.contains(lower, F.lit(word))
    else:
        gate = text.rlike(rule.pattern)
    return F.when(gate, found).otherwise(none)


def scan_blobs(blobs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(blob, rank, kind, start, end) for each match in (blob, text); ``rank`` is the rule's place in the list."""
    lowered = blobs.select("blob", "text", F.lower("text").alias("low"))
    each = F.concat(*[_matches(r, n, F.col("text"), F.col("low")) for n, r in enumerate(rules)])
    rows = lowered.select("blob", F.explode(each).alias("m")).select("blob", "m.*")
    so_far = Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("len")).over(so_far)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return rows.withColumn("end", end).where("ok").select(
        "blob", "rank", kinds[F.col("rank")].alias("kind"), (F.col("end") - F.col("len")).alias("start"), "end")


class Ledger:
    """Two tables below ``folder``: scanned (blob, rule_version, batch) and findings."""

    SCANNED = "blob string, rule_version string, batch string"
    FINDINGS = "blob string, rank int, kind string, start long, end long, rule_version string, batch string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        for name, schema in (("scanned", self.SCANNED), ("findings", self.FINDINGS)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.folder}/{name}")

    def scanned(self) -> DataFrame:
        return self.spark.read.schema(self.SCANNED).parquet(f"{self.folder}/scanned")

    def findings(self, rule_version: str) -> DataFrame:
        """What whole batches found."""
        done = self.scanned().where(F.col("rule_version") == rule_version).select("blob", "batch").distinct()
        found = self.spark.read.schema(self.FINDINGS).parquet(f"{self.folder}/findings")
        return found.where(F.col("rule_version") == rule_version).join(done, ["blob", "batch"], "left_semi").drop("batch", "rule_version")

    def update(self, contents: DataFrame, rules: list[Rule] = RULES, rule_version: str = RULE_VERSION) -> None:
        """Scan the blobs of (blob, text) that this rule version has not seen; a blob may come in many rows."""
        seen = self.scanned().where(F.col("rule_version") == rule_version).select("blob")
        unseen = contents.groupBy("blob").agg(F.first("text").alias("text")).join(seen, "blob", "left_anti")
        mark = {"rule_version": F.lit(rule_version), "batch": F.lit(uuid.uuid4().hex)}
        scan_blobs(unseen, rules).withColumns(mark).write.mode("append").parquet(f"{self.folder}/findings")
        # The batch counts from here on.
        contents.select("blob").distinct().join(seen, "blob", "left_anti").withColumns(mark).select(
            "blob", "rule_version", "batch").write.mode("append").parquet(f"{self.folder}/scanned")


def addressed(versions: DataFrame, text_col: str = "text", blob_col: str = "blob") -> DataFrame:
    return versions.withColumn(blob_col, F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))


def spans_of(versions: DataFrame, ledger: Ledger, *, text_col: str = "text", rules: list[Rule] = RULES,
             rule_version: str = RULE_VERSION, keep: list[str] | None = None, found_col: str = "found", blob_col: str = "_blob") -> DataFrame:
    """The ``keep`` columns of every row, its blob, and ``found_col``: its spans by start, then by rule.

    The spans are an array of (start, rank, kind, end), empty if there is none. Of the two added columns, one that
    the rows have already is replaced.
    """
    own = [c for c in (versions.columns if keep is None else keep) if c.lower() not in (found_col.lower(), blob_col.lower())]
    inner = spare_name(versions, "_address")
    named = addressed(versions, text_col, inner)
    ledger.update(named.select(F.col(inner).alias("blob"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), rules, rule_version)
    by_blob = ledger.findings(rule_version).groupBy(F.col("blob").alias(blob_col)).agg(
        F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias(found_col))
    rows = named.select(*own, F.col(inner).alias(blob_col))
    return rows.join(by_blob, blob_col, "left").withColumn(
        found_col, F.coalesce(found_col, F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")))


def redact(text: Column, found: Column, mark: str) -> Column:
    """The text with each span replaced by ``mark``; spans that touch or overlap become one.

    Walks over the sorted spans and builds the list of stretches that stay; text is cut once per span.
    """
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    walked = F.aggregate(found, start, lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["parts"]).when(
            (s["start"] == acc["at"]) & (acc["at"] > 0), acc["parts"]).otherwise(
            F.array_append(acc["parts"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")))).alias("parts")))
    last = F.substring(text, (walked["at"] + 1).cast("int"), F.length(text))
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(F.array_append(walked["parts"], last), mark))
