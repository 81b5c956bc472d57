"""The corpus pipeline, five stages over documents:

1. language ID: documents that it rejects (no letter, or a narrow margin between languages) go;
2. line dedup: lines equal to an earlier line, or from 20 characters on within one edit of one, are cut out; a document that loses all of its words that way goes;
3. MinHash near-dedup (five-word shingles, similarity 0.8 or more): of each component the first document stays;
4. benchmark decontamination: documents with a benchmark window (10 words) go;
5. byte-level BPE: each document is encoded and decoded again, and told by digests.

Stages 1 to 4 return the columns of documents; each works on all that the stage before kept. Texts without a row of their own to learn from are predicted all the same.
Null texts and texts without a letter go in stage 1.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import byte_bpe, common, decontaminate, language_id, line_dedup, near_dedup
from fleetlens.operators.durable import deleted


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(docs, drop_emptied=True)
    counted = cut.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return counted.select([F.col(f"`{c}`") for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", decontamination_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: Compression and tokenising are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result. Each stage's table goes once the next one is written; the last stays, as the result reads it."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        target = f"{common.checkpoint_path(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(target)
        if before:
            deleted(spark, before)
        docs, before = spark.read.parquet(target), target
    return STAGES[-1][1](spark, docs, sf_dir)
