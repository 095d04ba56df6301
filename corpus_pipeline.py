"""A training corpus from documents: quality, near-duplicates, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.llm import decontam, overlap, packing, pii, quality
from shroud.llm.scratch import write_table

#: Words of a shingle, and the Jaccard similarity of shingle sets from which documents are near copies.
WORDS, SIMILARITY = 5, 0.8
#: Bits by which the fingerprints of pairs that the SimHash index proposes may differ; an exact join finds the rest.
RADIUS = 3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the rule ensemble, trained on labels that aren't held out, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs.select("doc_id", quality.statistics(F.col("text")).alias("stats")), labels)
    stats = "statistics"
    while stats in docs.columns:
        stats += "_"
    scored = docs.withColumn(stats, quality.statistics(F.col("text")))
    return scored.where(model.score(F.col(stats)) >= 0.5).select(docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near copies; rows without an id stay."""
    return overlap.deduplicate(docs, words=WORDS, least=SIMILARITY, radius=RADIUS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; ``n_chars`` follows the text."""
    masked = pii.redact(docs, pii.train(pii.candidates(docs)))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else masked


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens along the curve."""
    files = {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}
    return packing.pack(docs, end_id=1, **files)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Tokens, fingerprint groups and trained models are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
