"""The queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sha256, shared_dir
from .clustering import clustered, clustering_sql
from .decontamination import contaminated
from .divergence import DIVERGENCE_SQL, audited
from .exact_dedup import exact_dedup
from .html_text import extract_pages
from .mixing import mixed, mixing_sql
from .packing import pack_conversations, pack_documents
from .secrets import secret_scan
from .shards import sharded
from .simhash import simhash_components
from .suffix_dedup import suffix_dedup
from .token_files import token_files
from .toxicity import toxicity_scores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), words=400_000).drop("loss_tokens")


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing with all three limits apart: the turns of conversations, of which the assistant's bear loss."""
    return pack_conversations(table(spark, sf_dir, "conversations"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = sharded(table(spark, sf_dir, "documents"), shared_dir(spark, "shards"))
    text = F.coalesce("text", F.lit(""))
    return store.read().select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), sha256(text).alias("text_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_simhash": op4_simhash,
    "op5_decontamination": op5_decontamination,
    "op6_packing": op6_packing,
    "instruction_packing": instruction_packing,
    "op7_sharding": op7_sharding,
    "op8_toxicity": op8_toxicity,
    "op9_token_files": op9_token_files,
    "op10_html_text": op10_html_text,
    "op11_clustering": op11_clustering,
    "op12_mixing": op12_mixing,
    "op13_divergence": op13_divergence,
}

SQL: dict[str, str] = {
    "op11_clustering": clustering_sql(),
    "op12_mixing": mixing_sql(),
    "op13_divergence": DIVERGENCE_SQL,
    "op7_sharding": """
        SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op2_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
}
