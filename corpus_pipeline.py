"""The corpus pipeline: documents in, packed training windows out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next stage's documents.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import decontam, jaccard, langid, pack, secrets
from sitelens.llm.common import table, unused
from sitelens.llm.queries import tokenizer_path
from sitelens.session import apply_conf, materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or without a prevailing language go; without labels to learn from, those without letters."""
    apply_conf(spark)
    return langid.keep_identified(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by five-word shingle sets that are 80 % alike, the least id stays."""
    apply_conf(spark)
    return jaccard.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    apply_conf(spark)
    return decontam.without_contamination(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; n_chars follows the text."""
    apply_conf(spark)
    length = unused(docs, "length_before")
    cleaned = secrets.redact_secrets(docs.withColumn(length, F.length("text")))
    changed = F.length("text") != F.col(length)
    return cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))) \
        .select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 2048 ids: one row per piece of a document."""
    apply_conf(spark)
    return pack.pack_documents(docs, tokenizer_path(), with_ids=True)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("packing", packing)]

ORACLE_SQL = None  # language scores, components and token ids are beyond SQL; the tests hold each stage to brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
