"""Streams with state, their rows in several micro-batches and out of order."""

import datetime
import os
import time

import duckdb
import pytest

from tessitura.plans.sql import SQL
from tessitura.sources import versions
from tessitura.streaming import arrivals, ordered, radio
from tessitura.streaming.player import Player

DAY = ordered.DAY_US


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def feed(spark, folder, ddl, slices):
    """A stream that brings one slice per micro-batch."""
    for rows in slices:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.02)
    return spark.readStream.schema(spark.createDataFrame([], ddl).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def results(stream, folder, mode="append"):
    return sorted((tuple(r) for r in radio.drain(stream, f"{folder}/out", f"{folder}/ck", [], mode).collect()), key=repr)


TICKS = [(1, at(10), 1, True), (1, at(10.5), 2, False), (1, at(30), 3, True), (1, at(31), 4, False), (1, at(32), 5, True), (1, at(32.4), 6, False), (2, at(5), 9, True)]
BEAT = (None, at(900_000), None, None)


@pytest.mark.parametrize("cut", [[[0, 3], [1, 2], [4, 5, 6]], [[5, 4, 6], [3], [2, 1, 0]], [range(7)]])
def test_listening_time_whatever_the_batches(spark, tmp_path, cut):
    stream = feed(spark, tmp_path, "account long, at timestamp, event_id long, playing boolean", [[TICKS[i] for i in part] for part in cut] + [[BEAT]])
    rows = results(ordered.listening_increments(stream, 1.0, "100 seconds"), tmp_path)
    assert sum(r[2] for r in rows if r[0] == 1) == 500 + 1000 + 400 and sum(r[3] for r in rows if r[0] == 1) == 3
    assert [r[2:] for r in rows if r[0] == 2] == [(0, 0)]


def test_ticks_behind_the_watermark_do_not_count(spark, tmp_path):
    # Spark holds rows against the watermark of the micro-batch before.
    late = [[(1, at(0), 1, True), (1, at(1), 2, False)], [(1, at(500), 3, False)], [(1, at(501), 4, False)], [(1, at(0.5), 9, False), (1, None, 8, True)], [BEAT]]
    rows = results(ordered.listening_increments(feed(spark, tmp_path, "account long, at timestamp, event_id long, playing boolean", late), 1.0, "10 seconds"), tmp_path)
    assert sum(r[2] for r in rows) == 1000


def test_sessions_close_by_signal_or_silence(spark, tmp_path):
    slices = [[(1, at(10), 1, "started"), (1, at(31), 4, "finished")], [(1, at(20), 2, "started"), (1, at(30), 3, "error")], [(1, at(40), 5, "started"), (2, at(35), 9, "started"), (3, at(36), 10, "finished")], [BEAT]]
    stream = feed(spark, tmp_path, "account long, at timestamp, event_id long, signal string", slices)
    us = lambda s: int((at(s) - datetime.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    want = [(1, 1, us(10), us(20), "source-change"), (1, 2, us(20), us(30), "error"), (1, 3, us(40), us(140), "timeout"), (2, 1, us(35), us(135), "timeout")]
    assert results(ordered.session_records(stream, 100_000_000, "100 seconds"), tmp_path) == sorted(want, key=repr)


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    ddl = "account long, at timestamp, event_id long, signal string"
    stream = feed(spark, tmp_path, ddl, [[(1, at(10), 1, "started")], [(1, at(90), 2, "finished")]])
    assert results(ordered.session_records(stream, DAY, "20 seconds"), tmp_path) == []
    stream = feed(spark, tmp_path, ddl, [[(2, at(91), 4, "stop")], [(1, at(50), 3, "started")], [BEAT]])  # the second is behind the watermark of 70 seconds, so it is left out
    rows = results(ordered.session_records(stream, DAY, "20 seconds"), tmp_path)
    assert [(r[1], r[4]) for r in rows] == [(1, "finished")]
    assert results(ordered.session_records(stream, DAY, "20 seconds"), tmp_path) == rows


def test_silent_accounts_are_forgotten(spark, tmp_path):
    day = lambda n: at(n * 86_400)
    slices = [[(1, day(2), 3, "c"), (1, day(0), 1, "a"), (2, day(1), 5, "x")], [(1, day(1), 2, "b"), (2, day(2.5), 6, "y")], [(1, day(6), 4, "d")], [(None, day(9.5), None, None)]]
    stream = feed(spark, tmp_path, "account long, at timestamp, event_id long, play string", slices)
    rows = results(ordered.remembered(stream, 3, 2, "1 day"), tmp_path)
    last = {a: max(r for r in rows if r[0] == a) for a in (1, 2)}
    first = int(datetime.datetime(2024, 1, 1).timestamp()) * 1_000_000
    assert last[1][2] == 1 and last[2][1:] == (first + int(5.5 * DAY), 0, None)
    assert all(r[2] <= 2 for r in rows)


def test_events_are_held_for_their_acknowledgement(spark, tmp_path):
    ddl = "session long, seq long, entry long, name string, kind string"
    slices = [[(1, 1, 5, "a", "e"), (1, 2, 6, "b", "e"), (1, 3, 5, "c", "e"), (1, 4, None, "pause", "e")], [(1, 5, 5, None, "a"), (1, 6, 5, "d", "e"), (1, 7, 6, "e", "e"), (2, 1, None, "x", "e")], [(1, 8, None, None, "a"), (1, 9, 9, "f", "e")], [(1, 10, 9, None, "a"), (1, 11, 9, "g", "e")]]
    stream = feed(spark, tmp_path, ddl, slices)
    rows = results(arrivals.accepted(stream.where("kind = 'e'").drop("kind"), stream.where("kind = 'a'").select("session", "seq", "entry"), 2), tmp_path)
    assert rows == sorted([(1, 3, 5, "c", True), (1, 4, None, "pause", False), (1, 6, 5, "d", False), (1, 9, 9, "f", True), (1, 11, 9, "g", False)], key=repr)


def test_results_of_old_requests_are_refused_as_they_come(spark, tmp_path):
    slices = [[("a", 1, 1, None), ("a", 3, 1, 10), ("b", 1, 4, 1)], [("a", 4, 2, None), ("a", 5, 1, 11), ("a", 6, None, None)], [("a", 7, 2, 12), ("a", 8, 3, None)], [("a", 9, 2, 13)]]
    stream = feed(spark, tmp_path, "key string, seq long, version long, id long", slices)
    rows = results(arrivals.judged_results(stream.where("id IS NOT NULL"), stream.where("id IS NULL").drop("id")), tmp_path)
    assert [(r[3], r[4]) for r in rows] == [(10, True), (11, False), (12, True), (13, False), (1, True)]


def test_counters_are_exact_and_their_sink_may_run_again(spark, tmp_path):
    slices = [[("s", 1, False), ("s", 1, True), ("s", 2, None)], [("s", 2, True), ("s", None, True), ("t", 1, False)], [("s", 1, False)]]
    stream = feed(spark, tmp_path, "station string, batch long, played boolean", slices)
    sink = radio.maxima_sink(f"{tmp_path}/counters", ["station"], ["received", "played"])
    ddl = "station string, received long, played long"
    assert radio.maxima(spark, f"{tmp_path}/counters", ddl).count() == 0
    radio.run_out(arrivals.batch_counts(stream), sink, f"{tmp_path}/ck", "update")
    want = [("s", 2, 2), ("t", 1, 0)]
    assert sorted(map(tuple, radio.maxima(spark, f"{tmp_path}/counters", ddl).collect())) == want
    sink(spark.createDataFrame([("s", 2, 1)], ddl), 0)  # the first micro-batch once more
    assert sorted(map(tuple, radio.maxima(spark, f"{tmp_path}/counters", ddl).collect())) == want


def test_one_writer_commits_a_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/pointers"
    with ThreadPoolExecutor(8) as pool:
        for n in range(25):
            won = list(pool.map(lambda i: versions.put_once(spark, f"{path}/{n}", str(i)), range(8)))  # noqa: B023
            assert sum(won) == 1 and (tmp_path / "pointers" / str(n)).read_text() == str(won.index(True))
    assert versions.commit(spark, path, {"a": 1}, -1) == 0 and versions.pointer(spark, path) == (0, {"a": 1})
    with pytest.raises(versions.StaleVersion):
        versions.commit(spark, path, {"a": 2}, -1)


def test_replacing_keeps_the_old_rows_until_the_new_are_there(spark, tmp_path):
    path = str(tmp_path / "state")
    write = lambda n: versions.replace(spark, path, spark.createDataFrame([(n,)], "n int").write.parquet)
    assert versions.current(spark, path) is None and write(1) == 0
    held = versions.current(spark, path)

    def dies(folder):
        assert versions.current(spark, path) == held
        spark.createDataFrame([(9,)], "n int").write.parquet(folder)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        versions.replace(spark, path, dies)
    assert versions.current(spark, path) == held and spark.read.parquet(held).first().n == 1
    assert [write(n) for n in (2, 3)] == [1, 2] and versions.versions(spark, path) == [1, 2]
    assert spark.read.parquet(versions.current(spark, path)).first().n == 3 and not (tmp_path / "state" / held.rsplit("/", 1)[1]).exists()


def test_radio_asks_once_halts_and_goes_on(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = [(s, n, f"{s}{n}", p, f"{s}-{3 * n + p}", p != 1, 2 if (s, n) == ("a", 2) else 0) for s in ("a", "b") for n in range(4) for p in range(4)]
    spark.createDataFrame(rows, "station string, n int, batch string, pos int, track string, available boolean, fails int").write.partitionBy("station").parquet(f"{folder}/service")
    player = Player(spark, f"{folder}/player")
    player.start(spark.createDataFrame([("a",), ("b",)], "station string"))
    player.start(spark.createDataFrame([("a",)], "station string"))
    accepted = lambda: sorted((r.station, r.seq, r.track, r.batch) for r in spark.read.parquet(f"{folder}/out").collect())
    player.run(f"{folder}/service", f"{folder}/out", f"{folder}/ck")
    assert [r.station for r in player.halted().collect()] == ["a"]
    held = accepted()
    assert {b for s, _, _, b in held if s == "a"} == {"a0", "a1"} and {b for s, _, _, b in held if s == "b"} == {"b0", "b1", "b2", "b3"}
    player.run(f"{folder}/service", f"{folder}/out", f"{folder}/ck")  # a restart asks for nothing and repeats nothing
    assert accepted() == held
    for _ in range(8):  # the batch fails twice for each track that asks for it
        player.retry()
        Player(spark, f"{folder}/player").run(f"{folder}/service", f"{folder}/out", f"{folder}/ck")
        if player.halted().isEmpty():
            break
    assert player.halted().isEmpty()
    want = [(s, k + 1, f"{s}-{t}", f"{s}{max(t - 1, 0) // 3}") for s in ("a", "b") for k, t in enumerate(x for x in range(13) if x % 3 != 1)]
    assert accepted() == sorted(want)
    last = player._state()[0]
    player.sink(f"{folder}/out")(spark.createDataFrame([("a", 9, "x", 0, "new", True, None)], "station string, n int, batch string, pos int, track string, available boolean, error string"), 0)
    assert player._state()[0] == last and accepted() == sorted(want)  # a micro-batch that was run before


def test_radio_station_asks_many_times_in_one_micro_batch(spark, tmp_path):
    """Forty batches of a station, every third of which fails once or twice, and errors beyond that halt it."""
    folder = f"file://{tmp_path}"
    rows = [(s, n, f"{s}{n}", p, f"{s}-{3 * n + p}", True, {0: n % 2 + 1}.get(n % 3, 0) + 3 * (s == "b" and n == 20)) for s in ("a", "b", "c") for n in range(40) for p in range(4)]
    spark.createDataFrame(rows, "station string, n int, batch string, pos int, track string, available boolean, fails int").write.partitionBy("station").parquet(f"{folder}/service")
    want = sorted((s, k + 1, f"{s}-{k}", f"{s}{max(k - 1, 0) // 3}") for s in ("a", "b", "c") for k in range(121))
    seen = lambda out: sorted((r.station, r.seq, r.track, r.batch) for r in spark.read.parquet(out).collect())
    for name, most, micro_batches in (("whole", 50_000, 1), ("cut", 70, 3)):  # 160 rows of answers, 21 of errors
        player = Player(spark, f"{folder}/{name}/player", again=2, most=most)
        player.start(spark.createDataFrame([("a",), ("b",), ("c",)], "station string"))
        player.run(f"{folder}/service", f"{folder}/{name}/out", f"{folder}/{name}/ck")
        assert sorted(os.listdir(tmp_path / name / "out")) == [f"micro_batch={n}" for n in range(micro_batches)]
        assert [r.station for r in player.halted().collect()] == ["b"]
        assert seen(f"{folder}/{name}/out") == [x for x in want if x[0] != "b" or int(x[3][1:]) < 20]
    player.retry()  # it has failed three times, and does not a fourth time
    player.run(f"{folder}/service", f"{folder}/cut/out", f"{folder}/cut/ck")
    assert seen(f"{folder}/cut/out") == want and player.halted().isEmpty()


def test_radio_query_is_its_sql_with_long_conversations(spark, tmp_path):
    """The first track of a conversation of 150 comes again when the player has forgotten it; 30 batches of a station."""
    import __spark_entry__

    rows = [(40 * k + s, t, "user", "x") for s in (0, 1) for k in range(30) for t in range(150 if k % 9 == 4 else 2 + k % 5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"file://{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = __spark_entry__.queries()["radio_source_stream"](spark, f"file://{tmp_path}").select("station", "seq", "batch", "track")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(SQL["radio_source_stream"]).fetchall())
