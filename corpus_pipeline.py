"""Corpus pipeline: toxicity, near duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of ``docs``, whatever their names. Toxicity is decided by id, the other stages judge each row.

Null and empty texts pass all filters; repeated rows are near duplicates of each other; texts are taken whole,
however long; an empty table stays empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, secrets
from plumbline.llm.decontaminate import contamination
from plumbline.llm.frames import read_table, row_key, spare_name, stage, staging_folder
from plumbline.llm.near_dedup import near_duplicates
from plumbline.llm.toxicity import toxicity

SECRET_MARK = "[secret]"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; an id goes if one of its rows does, a row without an id stays."""
    bad = toxicity(docs, read_table(spark, sf_dir, "labels")).where("score >= 0.5 AND id IS NOT NULL").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the smallest id; rows without an id come last.

    Rows are numbered in a written table, so texts that share an id are judged one by one. Rows without words stay.
    """
    row = spare_name(docs, "_row")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()))
    group = near_duplicates(rows, id_col=row).select(F.col("id").alias(row), F.col("component").alias("_group"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row).alias("row"))
    kept = rows.select("doc_id", row).join(group, row).groupBy("_group").agg(F.min(order)["row"].alias(row)).select(row)
    return rows.join(kept, row, "left_semi").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage of ten words or a whole shorter item go."""
    key = spare_name(docs, "_key")
    found, _ = contamination(docs, read_table(spark, sf_dir, "benchmark"))
    hit = found.where("n_hit > 0").select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, row_key("doc_id", "text")).join(hit, key, "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark, and ``n_chars`` follows the text."""
    ledger = secrets.Ledger(spark, f"{staging_folder(spark)}/ledger-{uuid.uuid4().hex}")
    spans = spare_name(docs, "_spans")
    found = secrets.spans_of(docs, ledger, found_col=spans, blob_col=spare_name(docs, "_address_of"))
    masked = found.withColumn("text", secrets.redact(F.col("text"), F.col(spans), SECRET_MARK))
    if "n_chars" in docs.columns:
        changed = F.when(F.size(spans) > 0, F.length("text")).otherwise(F.col("n_chars"))
        masked = masked.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of the ids and of the bytes that they decode to."""
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(docs, tokens, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated),
    ("secrets", mask_secrets), ("bpe", encode),
]
#: The fitted trees and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{staging_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
