"""Exact deduplication as a stateful stream, with DataFrame functions only.

Arrivals are rows (digest, identifier, content locator). A streaming aggregation keyed by the
digest keeps them in RocksDB state on disk, without a watermark and so without expiry: how many
rows came, and of these the largest identifier with its locator. After the stream has drained, the
state is read back with Spark's state reader. Where a digest was hit more than once, the full bytes
are fetched again and compared with those of the row that stays; rows whose bytes differ are
grouped by their whole text.

Hot texts cost little: the aggregation combines before its shuffle, and the joins are plain equi
joins that adaptive execution may split.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sha256, shared_dir, spare, staged, without

#: RocksDB on disk, with its memory bounded for the whole executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrivals(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Column | None = None) -> DataFrame:
    """What the state keeps of each row: digest, identifier, and file and row number as the content locator.

    ``docs`` is a batch or a streaming read of files.
    """
    where = docs.select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"), F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return where.select((sha256("body") if digest is None else digest).alias("digest"), "id", "at", "body")


def from_files(docs: DataFrame) -> DataFrame:
    """``docs`` if it is a plain read of files, whose rows have locators; else it is written to the shared folder and read."""
    try:
        docs.select("_metadata.file_path").schema  # noqa: B018
    except AnalysisException:
        return staged(docs, "dedup-input")
    return docs


def drain(spark: SparkSession, stream: DataFrame, checkpoint: str) -> DataFrame:
    """Run a stream of arrivals until it has no more, then read its state: ``digest, n, id, at``.

    Started again with the same checkpoint it goes on from its state, so later arrivals are held
    against all earlier ones.
    """
    state = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "at")).alias("last"))
    with _settings(spark, STATE):
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
        kept = spark.read.format("statestore").load(checkpoint)
    buffers = [f.name for f in kept.schema["value"].dataType]
    return kept.select(F.col("key.digest").alias("digest"), F.col(f"value.{buffers[0]}").alias("n"), F.col(f"value.{buffers[1]}.id").alias("id"), F.col(f"value.{buffers[1]}.at").alias("at"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Column | None = None, broadcast_rows: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, at``.

    Texts are equal when their bytes are; a null text is empty. Of equal texts the row with the
    largest key stays; of repeated rows with that key, one (the last by file and row). Null keys
    count as smallest. Empty tables give no rows; other columns are not read. ``digest`` replaces
    SHA-256 of ``body`` (in tests, by one that collides). The digests that were hit are broadcast if
    they are at most ``broadcast_rows``; beyond that the texts are shuffled once.
    """
    spark = docs.sparkSession
    docs = from_files(docs)
    seen = arrivals(docs, key, text, digest)
    log = staged(seen.select("digest", "id", "at", *([sha256("body").alias("sha")] if digest is not None else [])), "dedup-arrivals")
    folder = log.inputFiles()[0].rsplit("/", 1)[0] if log.inputFiles() else None
    if folder is None:
        return log.select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"), "at")
    stream = spark.readStream.schema(log.schema).parquet(folder).select("digest", "id", "at")
    state = staged(drain(spark, stream, shared_dir(spark, "dedup-state")), "dedup-groups")

    # Only rows of groups that were hit are compared; their texts are fetched once and kept apart.
    keepers = staged(state.where("n > 1").select("digest", F.col("at").alias("keep_at"), F.col("id").alias("keeper_id")), "dedup-hits")
    bounded = keepers.count() <= broadcast_rows
    text_of = staged(seen.join(F.broadcast(keepers) if bounded else keepers, "digest"), "dedup-texts")
    first = text_of.where(F.col("at").eqNullSafe(F.col("keep_at")) & F.col("id").eqNullSafe(F.col("keeper_id"))).groupBy("digest").agg(F.max("body").alias("keep_body"))
    first = staged(first, "dedup-keepers")  # apart from the join, whose other side may then be split where a text is hot
    checked = text_of.join(first, "digest").where(F.col("body") != F.col("keep_body")).select("digest")
    different = staged(checked, "dedup-different").distinct()  # apart from the join, which may then be split where a text is hot

    groups = state.select("digest", "n", F.col("id").alias("keep_id"), F.col("at").alias("keep_at"))
    rows = log.join(groups, "digest")
    sha = F.col("sha") if digest is not None else F.col("digest")
    if not different.isEmpty():
        whole = seen.join(different, "digest", "left_semi")
        exact = whole.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "at")).alias("last"))
        apart = exact.select(F.col("digest"), sha256("body").alias("sha"), "n", F.col("last.id").alias("keep_id"), F.col("last.at").alias("keep_at"))
        log_sha = log if digest is not None else log.withColumn("sha", F.col("digest"))
        rows = rows.join(different, "digest", "left_anti").unionByName(log_sha.join(apart, ["digest", "sha"]), allowMissingColumns=True)
        sha = F.coalesce(F.col("sha"), F.col("digest")) if digest is None else F.col("sha")
    mine = F.col("id").eqNullSafe(F.col("keep_id")) & F.col("at").eqNullSafe(F.col("keep_at"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), mine.alias("kept"), sha.alias("text_sha256"), "at")


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns as they are.

    Of equal texts the row with the largest key stays, of equal keys the last by file and row; null keys come before
    all others. A null text is empty; long texts are compared whole; repeated rows are copies; an empty table stays empty.
    """
    docs = from_files(docs)
    file, row = spare(docs, "__file", "__row")
    gone = exact_dedup(docs, key, text).where("NOT kept").select(F.col("at.file").alias(file), F.col("at.row").alias(row))
    located = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    return without(located, gone, [file, row]).drop(file, row)
