"""Exact deduplication against a dictionary, with and without a digest that collides."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessitura.llm.exact_dedup import arrivals, drain, exact_dedup
from tessitura.llm.common import shared_dir

TEXTS = ["a", "b", None, "", "a", "a ", "é", "x" * 100_000, "x" * 100_000, "a"]


def brute(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault(text or "", []).append(key)
    return sorted((str(k), str(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows)


@pytest.mark.parametrize("weak", [False, True])
def test_groups_and_survivors(spark, tmp_path, weak):
    digest = F.crc32(F.substring("body", 1, 1).cast("binary")).cast("string") if weak else None
    rows = [*enumerate(TEXTS), (9, "a"), (None, "b"), (None, "only")]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(k, t, "p", 1) for k, t in rows], "doc_id long, text string, digest string, n int").write.parquet(path)
    got = exact_dedup(spark.read.parquet(path), digest=digest).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t in rows}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_rows_that_are_not_from_files_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in exact_dedup(df).collect()) == [(1, 2, False), (2, 2, True), (3, 3, True)]
    assert exact_dedup(df.limit(0)).count() == 0


def test_state_outlives_a_stream(spark, tmp_path):
    path, state = str(tmp_path / "in"), shared_dir(spark, "state-test")
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(path)
    stream = lambda: arrivals(spark.readStream.schema(schema).parquet(path)).drop("body")
    assert {r.n for r in drain(spark, stream(), state).collect()} == {1}
    spark.createDataFrame([(7, "a")], schema).write.mode("append").parquet(path)
    assert sorted((r.n, r.id) for r in drain(spark, stream(), state).collect()) == [(1, 2), (2, 7)]
