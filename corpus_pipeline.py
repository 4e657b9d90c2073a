"""The corpus pipeline (part of veracity.llm): quality, near-duplicates, benchmark passages,
personal data, pieces. Each stage works on all that the one before it kept.

A row keeps the columns of documents until the last stage, which gives its piece ids and decodes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.llm import decontaminate, neardup, pieces, pii, quality
from veracity.llm.common import drop_folder, shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.classify(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the smallest id stays."""
    return neardup.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind."""
    return pii.redact(docs, pii.train(docs))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_pieces, the piece ids of the text, and whether they give it back."""
    both = pieces.round_trip(docs)
    return both.select("doc_id", "source", "lang", F.size("pieces").cast("long").alias("n_pieces"), "pieces", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]

#: No SQL: the classifier, the field and the pieces are beyond it. tests/llm holds the classifier to its
#: labels, and the other stages of run() against brute force (the field's weights are taken as trained).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and reread."""
    docs, root = table(spark, sf_dir, "documents"), shared_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{root}/{i}")
        docs = spark.read.parquet(f"{root}/{i}")
        if i:
            drop_folder(spark, f"{root}/{i - 1}")
    return docs
