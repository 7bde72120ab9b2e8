"""Search in titles and texts by an index of letter triples, under full Unicode case folding.

A row is found if the folded query stands in its folded text. The index holds each triple of letters of every text
once; rows that have all triples of the query are candidates, and those are looked at. It finds what the scan finds.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Case folding by Unicode's rule: letters that fold to one letter, and those that fold to several.
_FOLDED = {chr(c): chr(c).casefold() for c in range(sys.maxunicode + 1) if chr(c).casefold() != chr(c)}
_ONE = {c: f for c, f in _FOLDED.items() if len(f) == 1}
_SEVERAL = {c: f for c, f in _FOLDED.items() if len(f) > 1}


def case_folded(text: str | Column) -> Column:
    """Full case folding: as Python's ``str.casefold``, with ligatures, sharp s and final sigma."""
    text = F.col(text) if isinstance(text, str) else text
    one = F.translate(text, "".join(_ONE), "".join(_ONE.values()))
    several = one
    for c, f in _SEVERAL.items():
        several = F.replace(several, F.lit(c), F.lit(f))
    return F.when(F.rlike(one, F.lit(f"[{''.join(map(re.escape, _SEVERAL))}]")), several).otherwise(one)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, title) with their title in full case folding: ligatures, sharp s and final sigma too."""
    for batch in batches:
        folded = pa.array([(t or "").casefold() for t in batch.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, folded], names=["id", "title", "folded"])


def _postings(most: int):
    """Rows (id, folded) to lists (triple, ids): one for each triple of so many rows that they hold about ``most`` postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[str, list[int]] = defaultdict(list)
        ids, held, kind = [], 0, None

        def lists() -> pa.RecordBatch:
            triples = sorted(at)
            ends = pa.array([0, *accumulate(len(at[t]) for t in triples)], pa.int32())
            rows = pa.array([i for t in triples for i in at[t]], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(triples, pa.string()), pa.ListArray.from_arrays(ends, pa.array(ids, kind).take(rows))], names=["triple", "ids"])

        for batch in batches:
            kind = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {text[i : i + 3] for i in range(len(text) - 2)}
                for triple in found:
                    at[triple].append(len(ids))
                ids.append(key)
                held += len(found)
                if held >= most:
                    yield lists()
                    at.clear(), ids.clear()
                    held = 0
        if at:
            yield lists()

    return run


def build_index(rows: DataFrame, path: str, most: int = 1_000_000) -> None:
    """Index rows (id, title) under ``path``: their titles with the folded form, and lists of ids per triple, which a filter on it can skip.

    Lists are made where the texts lie: a task's lists, of about ``most`` postings each time, are sorted by triple in its files.
    """
    key = rows.schema["id"].dataType.simpleString()
    texts = rows.select("id", F.col("title").cast("string").alias("title")).mapInArrow(_folded, f"id {key}, title string, folded string")
    texts.write.parquet(f"{path}/texts")
    held = rows.sparkSession.read.schema(texts.schema).parquet(f"{path}/texts")
    held.select("id", "folded").mapInArrow(_postings(most), f"triple string, ids array<{key}>").sortWithinPartitions("triple").write.parquet(f"{path}/postings")


def search(spark: SparkSession, path: str, query: str) -> DataFrame:
    """``id, title`` of the indexed rows that have ``query`` in them, whatever its case; all rows for an empty query.

    A query of fewer than three letters has no triple: then the folded texts are scanned. Ids are those of the
    rows; rows that share one are looked at each on its own. A null title is empty.
    """
    wanted = query.casefold()
    texts = spark.read.parquet(f"{path}/texts")
    parts = sorted({wanted[i : i + 3] for i in range(len(wanted) - 2)})
    if parts:
        hits = spark.read.parquet(f"{path}/postings").where(F.col("triple").isin(parts)).select("triple", F.explode("ids").alias("id")).groupBy("id").agg(F.count_distinct("triple").alias("n"))
        texts = texts.join(hits.where(F.col("n") == len(parts)).select("id"), "id", "left_semi")
    return texts.where(F.contains("folded", F.lit(wanted))).select("id", "title")
