"""Steps whose cost must not grow faster than their input."""

import pandas as pd

from tessitura.operators import history, library, search, sequence
from tessitura.streaming import arrivals, ordered


class Value:
    """A value of state that counts how often it is asked for and written."""

    def __init__(self):
        self.value, self.asked, self.written = None, 0, 0

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.value, self.written = value, self.written + 1


class Handle:
    def __init__(self):
        self.values, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.values.setdefault(name, Value())

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, timer):
        self.timers.remove(timer)

    def registerTimer(self, timer):
        self.timers.append(timer)

    def getCurrentWatermarkInMs(self):
        return 0


def test_a_bucket_of_sessions_is_read_and_written_once_per_micro_batch():
    handle, fold = Handle(), arrivals.Acceptance(1)
    fold.init(handle)
    frame = pd.DataFrame([(3, str(k), seq, kind, "5", "e") for k in range(1000) for seq, kind in ((2, "event"), (1, "event"))], columns=["bucket", "key", "seq", "kind", "entry", "name"])
    assert list(fold.handleInputRows((3,), iter([frame]), handle)) == []
    acks = frame[frame.seq == 2].assign(kind="ack", seq=3)
    (found,) = fold.handleInputRows((3,), iter([acks]), handle)
    assert len(found) == 1000 and set(zip(found.seq, found.replayed)) == {(2, True)}
    assert {(v.asked, v.written) for v in handle.values.values()} == {(2, 2)}


def test_a_bucket_of_accounts_has_one_timer():
    handle, fold = Handle(), ordered.PlaySessions(10)
    fold.init(handle)
    frame = pd.DataFrame([(0, str(k), 5_000_000 + k, k, "started") for k in range(500)], columns=["bucket", "key", "at_us", "id", "signal"])
    assert list(fold.handleInputRows((0,), iter([frame]), handle)) == []
    assert len(handle.timers) == 1 and {(v.asked, v.written) for v in handle.values.values()} == {(1, 1)}


def test_batches_are_counted_by_native_operators(spark, tmp_path):
    ddl = "station string, batch long, played boolean"
    spark.createDataFrame([("s", 1, True)], ddl).write.parquet(f"{tmp_path}/in")
    plan = arrivals.batch_counts(spark.readStream.schema(ddl).parquet(f"{tmp_path}/in"))._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in plan and "TransformWithState" not in plan


def test_queues_are_not_dealt_by_the_id_that_most_rows_have(spark):
    ids = spark.range(4000).selectExpr("id % 50 AS seq_id", "CAST(id AS INT) AS pos", "concat(IF(id % 10 = 0, id, 7), ':', id) AS full_id")
    loaded = spark.range(3000).selectExpr("CAST(id AS STRING) AS id", "concat('t', id) AS title", "id % 2 = 0 AS available", "'track' AS kind")
    queue = sequence.queue_build(ids, loaded)
    fresh = loaded.where("available")
    for found in (queue, sequence.refresh(queue, fresh)):
        assert "hashpartitioning(id" not in found._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(queue) == rows(sequence.queue_build(ids, loaded, 0)) and rows(sequence.refresh(queue, fresh)) == rows(sequence.refresh(queue, fresh, 0))
    assert queue.where("title = 't7'").count() == 3600


def test_long_queues_are_dealt_over_more_tasks(spark):
    rows = spark.range(1000)
    assert sequence.dealt(rows, 1000, "id", per_task=100).rdd.getNumPartitions() == 10
    assert sequence.dealt(rows, 1000, "id") is rows


def test_a_micro_batch_of_the_player_is_one_pass_over_a_station():
    import pyarrow as pa

    from tessitura.streaming.player import _played

    names = ["station", "seq", "batch", "track", "played", "turn", "previous", "attempt", "halted", "pos", "available", "error", "part"]
    row = lambda **r: {n: r.get(n) for n in names}
    held = [row(part="queue", station="a", seq=k, batch="x", track=t, played=k == 1) for k, t in ((1, "p"), (2, "q"))]
    held.append(row(part="control", station="a", turn=3, previous="p", attempt=1, halted=False))
    new = [row(part="new", station="a", batch="y", track=t, pos=k, available=t != "s") for k, t in enumerate(("q", "r", "s", "t", "r", "u"))]
    found = _played(2, 1)(pa.Table.from_pylist(held + new)).to_pylist()
    of = lambda part: [r for r in found if r["part"] == part]
    assert [(r["seq"], r["track"], r["batch"]) for r in of("out")] == [(3, "r", "y"), (4, "t", "y"), (5, "u", "y")]
    assert [(r["seq"], r["played"]) for r in of("queue")] == [(3, True), (4, False), (5, False)]
    assert [(r["turn"], r["previous"], r["attempt"], r["halted"]) for r in of("control")] == [(4, "r", 0, False)]
    failed = _played(2, 1)(pa.Table.from_pylist([*held, row(part="new", station="a", batch="y", error="UNAVAILABLE")])).to_pylist()
    assert [(r["turn"], r["previous"], r["attempt"], r["halted"]) for r in failed if r["part"] == "control"] == [(3, "p", 2, True)]


def exchanges(found):
    return found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_queues_of_several_tasks_are_dealt_whatever_the_sessions_number(spark):
    assert sequence.dealt(spark.range(1000), 1000, "id", per_task=500).rdd.getNumPartitions() == 2 < int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_queue_is_extended_in_one_shuffle_by_sequence(spark):
    queue = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (3, 4, None), (None, 2, "a")], "seq_id long, pos int, id string")
    rows = spark.createDataFrame([(1, 5, "c", True), (1, 2, "a", True), (1, 3, "d", False), (1, 4, "c", True), (1, 7, "e", True), (3, 0, None, True), (4, 9, "z", True), (None, 1, "a", True)], "seq_id long, pos int, id string, available boolean")
    found = sequence.extend(queue, rows, 600_000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(seq_id") == plan.count("Exchange hashpartitioning") == 1 and found.rdd.getNumPartitions() == 3
    new = [(1, 2, "c"), (1, 3, "e"), (3, 5, None), (4, 0, "z"), (None, 0, "a")]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([*map(tuple, queue.collect()), *new], key=repr)


def test_likes_and_changes_are_shuffled_once(spark):
    likes = spark.range(40).selectExpr("id % 4 AS account", "id AS place", "concat(id, ':1') AS full_id")
    changes = spark.range(100).selectExpr("id % 4 AS account", "id AS seq", "CAST(id % 50 AS STRING) AS track_id", "CAST(NULL AS STRING) AS album_id", "id % 3 <> 0 AS liked", "'confirmed' AS status")
    assert exchanges(library.merged_places(likes, changes)) == 1
    rows = {(r.account, r.full_id.split(":")[0]): (r.place, r.full_id) for r in likes.collect()}
    for r in changes.orderBy("seq").collect():
        if not r.liked:
            rows.pop((r.account, r.track_id), None)
        else:
            rows.setdefault((r.account, r.track_id), (-1 - r.seq, r.track_id))
    assert sorted(map(tuple, library.merged_places(likes, changes).collect())) == sorted((k[0], *v) for k, v in rows.items())


def test_the_index_is_made_where_the_texts_lie_in_lists(spark, tmp_path):
    rows = spark.range(300).selectExpr("id", "concat('abcdef', id) AS title").coalesce(2)
    search.build_index(rows, str(tmp_path / "index"), 1000)
    lists = spark.read.parquet(str(tmp_path / "index/postings"))
    assert lists.where("triple = 'abc'").count() < 10 and lists.where("triple = 'abc'").selectExpr("sum(size(ids))").first()[0] == 300
    assert sorted(r.id for r in search.search(spark, str(tmp_path / "index"), "F29").collect()) == [29, *range(290, 300)]


def test_runs_of_a_key_are_given_whole_and_go_out_together():
    import pyarrow as pa

    batch = lambda *keys: pa.RecordBatch.from_pydict({"seq_id": pa.array(keys, pa.int64()), "n": pa.array(range(len(keys)), pa.int64())})
    each = lambda key, rows: {"seq_id": [key], "place": [len(rows)]}
    found = list(history.by_run(["seq_id"], each)(iter([batch(1, 1, 2), batch(), batch(2), batch(2, 3)])))
    assert [b.to_pydict() for b in found] == [{"seq_id": [1, 2, 3], "place": [2, 3, 1]}]
    assert len(list(history.by_run(["seq_id"], each, 1)(iter([batch(1, 1, 2), batch(2, 3)])))) == 3
