"""A training corpus from ``documents``: toxicity, exact and near duplicates, benchmark leaks, packing.

Each stage takes the session, the rows the stage before it kept, and the folder of tables. All but
the last return the columns of ``documents``, others too, as they are; the last returns packed pieces.

For every stage a null text is an empty one, long texts count whole, an empty table gives none, and a null or
repeated key stands for no other row: rows are told apart by file and row, or judged by their own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessitura.llm.common import shared_dir
from tessitura.llm.decontamination import drop_contaminated
from tessitura.llm.exact_dedup import drop_exact_duplicates
from tessitura.llm.packing import pack_documents
from tessitura.llm.simhash import drop_near_duplicates
from tessitura.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out rows that score as toxic; equal texts score alike. Without labels of both kinds, or terms that depend on them, all rows stay."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, empty ones too, the one with the largest key stays, null keys before all others; of equal keys the last by file and row."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a Jaccard similarity of 0.8 or more of their five-word shingles, directly or through others, the one with the smallest key stays, null keys last; of equal keys the first by file and row. Texts without words are alike."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out rows that hold 80 % or more of a benchmark item; each row stands for itself. Without items all rows stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 2,048 tokens; an empty text is one token, repeated rows are packed each on its own, null keys stay null."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL has no TF-IDF neighbours, SimHash components, string tiling or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every stage but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
