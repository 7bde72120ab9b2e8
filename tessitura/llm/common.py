"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only on a local master, where that is unset, as in
    tests, a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessitura-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    df.sparkSession._jvm.System.gc()  # a hint: Spark's cleaner drops shuffle files once the driver has collected their plans
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables made by :func:`staged` that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and whole text, nothing else; a null text is empty."""
    return df.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def sha256(text: Column | str) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, so that a task holds few Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_map(schema: pa.Schema, each: Callable[[pa.RecordBatch], dict], rows: int = 512):
    """A function for ``mapInArrow``: ``each`` makes the columns of ``schema`` from a slice of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows):
            yield pa.RecordBatch.from_pydict(each(part), schema=schema)

    return run


def spare(docs: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until no column of ``docs`` has them."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def without(docs: DataFrame, dropped: DataFrame, keys: list[str], broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows whose ``keys`` are in ``dropped`` (null equals null); all columns stay as they are.

    The dropped keys, of fixed or short width, are broadcast if they are at most ``broadcast_rows``, else both sides are shuffled.
    """
    gone = staged(dropped.select(*(F.col(k).alias(f"__gone_{k}") for k in keys)).distinct(), "dropped")
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__gone_{k}"))
    return docs.join(gone, condition, "left_anti")


def small(table: DataFrame, most: int = 8_000_000) -> DataFrame:
    """``table`` (written before) with a hint to broadcast it if its files hold at most ``most`` bytes, else as it is."""
    spark = table.sparkSession
    path = lambda f: spark._jvm.org.apache.hadoop.fs.Path(f)
    size = 0
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        size += path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path(folder)).getLength()
    return F.broadcast(table) if size <= most else table


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``number``, their place by ``key`` from 0, without bringing them into one task.

    Rows are dealt by ranges; a range's rows are numbered in a window of their own, after those of the ranges before it.
    """
    dealt = staged(rows.repartitionByRange(key).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"))  # a row per partition
    before = counts.select("__range", (F.sum("__rows").over(Window.orderBy("__range")) - F.col("__rows")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return dealt.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn("number", F.col("__before") + F.col("__own")).drop("__range", "__own", "__before")
