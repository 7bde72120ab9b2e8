"""The shard store: contents, tiers, versions, conflicts."""

import pytest

from tessitura.llm.shards import Conflict, ShardStore, arrivals_of, sharded


def rows(spark, a, b):
    return spark.range(a, b, 1, 2).selectExpr("id AS doc_id", "CASE WHEN id % 7 <> 0 THEN repeat(md5(string(id)), 40) END AS text")


def test_appends_merge_into_larger_runs_and_lose_nothing(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, fan_in=3, smallest_bytes=1 << 14)
    for i in range(10):
        store.append(rows(spark, 100 * i, 100 * i + 100))
        store.compact()
        assert store.read().count() == 100 * i + 100
    runs = store.manifest()["runs"]
    assert len(runs) < 7 and store.manifest()["version"] > 10
    store.vacuum(older_than=0)
    assert store.versions() == [store.manifest()["version"]]
    assert sorted(tuple(r) for r in store.read().collect()) == sorted(tuple(r) for r in rows(spark, 0, 1000).collect())
    assert {f"data/{r['run']}" for r in runs} == {f"data/{p.name}" for p in (tmp_path / "s" / "data").iterdir()}


def test_old_versions_read_whole_and_a_version_is_committed_once(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    first = store.append(rows(spark, 0, 10))
    base = store.manifest()
    store.append(rows(spark, 10, 30))
    assert store.read(first["version"]).count() == 10 and store.read().count() == 30
    with pytest.raises(Conflict):
        store.commit(base, [], base["schema"])
    assert store.read().count() == 30
    with pytest.raises(ValueError):
        store.append(spark.range(3))


def test_a_vacuum_frees_no_version_for_a_stale_writer(spark, tmp_path):
    a, b = (ShardStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    stale = a.append(rows(spark, 0, 10))
    run = a._write(rows(spark, 90, 95))
    for i in (1, 2, 3):
        b.append(rows(spark, 10 * i, 10 * i + 10))
    b.vacuum(older_than=0)
    assert b.versions() == [4]
    with pytest.raises(Conflict):
        a.commit(stale, [*stale["runs"], run], stale["schema"])

    # The same where the stale writer looked before the others went on: its number is free, but not the last.
    look = a.versions
    a.versions = lambda: [1] if len(calls) == 0 and not calls.append(1) else look()
    calls = []
    with pytest.raises(Conflict):
        a.commit(stale, [*stale["runs"], run], stale["schema"])
    a.versions = look
    assert a.versions() == [4] and a.read().count() == 40
    a.append(rows(spark, 90, 95))
    assert b.read().count() == 45 and b.versions() == [4, 5]


def test_age_keeps_what_readers_and_writers_may_need(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", fan_in=2)
    first = store.append(rows(spark, 0, 10))
    store.append(rows(spark, 10, 20))
    store.compact()
    pending = store._write(rows(spark, 20, 30))
    store.vacuum()
    assert store.read(first["version"]).count() == 10 and store.read().count() == 20
    now = store.manifest()
    store.commit(now, [*now["runs"], pending], now["schema"])
    assert store.read().count() == 30


def test_filters_and_expressions_hold(spark, tmp_path):
    spark.range(0, 800, 1, 8).selectExpr("id AS doc_id", "repeat('x', 50) AS text").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"file://{tmp_path}/t")
    assert len(table.inputFiles()) == 8
    some = table.where("doc_id % 10 = 3").selectExpr("doc_id", "upper(text) AS text", "doc_id * 2 AS twice")
    for name, df in (("a", some), ("b", some.unionByName(some)), ("c", some.where("doc_id < 100"))):
        got = sharded(df, f"file://{tmp_path}/{name}").read()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect())) and got.columns == df.columns
    parts = arrivals_of(some, 5)
    assert sum(p.count() for p in parts) == 80


def test_small_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (None, None, "x")], "doc_id long, text string, file string")
    assert sharded(df, f"file://{tmp_path}/a", arrivals=3).read().count() == 3
    store = sharded(df.limit(0), f"file://{tmp_path}/b")
    assert store.read() is None or store.read().count() == 0


def test_of_two_writers_at_once_one_commits(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    stores = [ShardStore(spark, f"file://{tmp_path}/s") for _ in range(2)]
    schema = stores[0].append(rows(spark, 0, 5))["schema"]
    for turn in range(200):
        base, gate = stores[0].manifest(), Barrier(2)

        def write(store, base=base, gate=gate):
            look = store.versions

            def held():  # both have looked before either goes on
                found = look()
                if store.versions is held:
                    store.versions = look
                    gate.wait()
                return found

            store.versions = held
            try:
                return store.commit(base, base["runs"], schema)
            except Conflict:
                return None

        with ThreadPoolExecutor(2) as pool:
            won = [w for w in pool.map(write, stores) if w]
        assert len(won) == 1 and stores[1].manifest()["id"] == won[0]["id"] and won[0]["version"] == turn + 2


def test_stores_without_exclusive_creation_are_refused(spark, tmp_path):
    from tessitura.sources import versions

    class Elsewhere:
        def __getattr__(self, name):
            return lambda *a: self if name in ("resolvePath", "toUri", "getParent") else "s3a"

    before, versions.hadoop_path = versions.hadoop_path, lambda *_: (Elsewhere(), Elsewhere())
    try:
        with pytest.raises(ValueError, match="s3a"):
            versions.put_once(spark, "s3a://bucket/x", "{}")
    finally:
        versions.hadoop_path = before
