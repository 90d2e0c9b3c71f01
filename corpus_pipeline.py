"""The corpus pipeline: five stages from ``documents`` to token ids, each one operator of ``pitloom.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitloom.llm import byte_bpe, dart_minhash, decontamination, quality_cnn, quality_outliers
from pitloom.llm.common import table
from pitloom.llm.queries import rank_file
from pitloom.session import scratch_path

#: The classifier, the robust estimates and the groups of copies follow from trained or iterative models.
ORACLE_SQL = None
_SCORE = "__pitloom_score"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network scores 0.3 or more."""
    fold = ~quality_cnn.held_out(F.col("doc_id"))
    net = quality_cnn.fit(docs, table(spark, sf_dir, "labels"), fold)
    scored = docs.withColumn(_SCORE, quality_cnn.score(F.col("text"), net))
    return scored.filter(F.col(_SCORE) >= quality_cnn.THRESHOLD).drop(_SCORE)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality_outliers.filter_outliers(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return dart_minhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark passage contaminates."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, proven by decoding: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return byte_bpe.digests(byte_bpe.round_trip(docs, rank_file(), public_tokenizers.PATTERN))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
