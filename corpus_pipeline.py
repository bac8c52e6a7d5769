"""A corpus from documents to token ids: STAGES, each written as Parquet and read again by the next.

Defined results, in every stage: null texts count as empty and stay; rows without doc_id stay unless
their own text is toxic or holds a benchmark window, as they are nobody's copy; rows that repeat a doc_id are
one document for line dedup and near-dedup, so they stay or go together; columns besides doc_id and text are
handed on, whatever their names; empty tables stay empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import bpe, decontaminate, lines, minhash, toxicity
from loomframe.llm.common import shared_dir, stored, table


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold, by a model fitted on those with labels."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line nearly equals, short ones too; n_chars follows the text."""
    out = lines.dedup_lines(docs, min_words=1)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; those without doc_id are told apart by their texts."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("no doc_id"), F.col("text")))
    found = decontaminate.contamination(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), near=0)
    gone = stored(found.where(F.size("hits") > 0).select(F.col("doc_id").alias("contaminated doc")).distinct())
    few = gone.count() <= lines.SMALL_ROWS  # 8 bytes each; beyond, the join shuffles
    return docs.join(F.broadcast(gone) if few else gone, key == F.col("contaminated doc"), "left_anti").select(docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text they decode to, and the ids."""
    return bpe.round_trip(docs, bpe.default_path(), with_ids=True)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("line_dedup", without_repeated_lines),
    ("minhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("bpe", to_tokens),
]

#: A trained model and a tokenizer's merges are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What each stage keeps is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
