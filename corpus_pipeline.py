"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, secret scans, tokenization.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.  run() writes what each stage returns as
Parquet under the folder that the cluster names in spark.checkpoint.dir, and reads it again for the next, so a lost executor
costs no more than the running stage.

  quality     documents that the line sequence labels reject are dropped
  near_dups   of each group of similar documents the one with the least doc_id stays
  benchmark   documents that hold a test item are dropped
  secrets     secrets are replaced; n_chars follows; no document is dropped
  tokenize    (doc_id, ids, n_tokens, decoded, lossless) of every text

Null and empty texts are dropped by the first stage.  Rows without doc_id pass the second and third.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from marlwick.llm import decontaminate, jaccard_join, line_quality, secret_scan, wfst_tokenizer
from marlwick.llm.common import documents
from marlwick.sources.store import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_secrets(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return wfst_tokenizer.encode_decode(docs, wfst_tokenizer.default_model(spark))


STAGES = [("quality", quality), ("near_dups", near_dups), ("benchmark", benchmark), ("secrets", secrets), ("tokenize", tokenize)]

#: No stage but the near duplicates can be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents table."""
    folder, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
