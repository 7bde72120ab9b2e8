"""Golden cases of the engine's operators on small relations."""

import datetime
import hashlib
import io
import os
import tarfile
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from tessitura.functions import expr
from tessitura.operators import audit, catalog, library, listening, media, recommend, sequence
from tessitura.sources import tables
from tessitura.streaming import radio

LIKE = "account long, pos int, full_id string"
CHANGE = "account long, seq int, track_id string, album_id string, liked boolean, status string"
QUEUE = "seq_id long, pos int, full_id string, id string, title string, available boolean, base_pos int"


def likes(spark, *ids):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(ids)], LIKE)


def in_order(df, *columns, by="pos"):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.orderBy(by).collect()]


def queue(spark, n, unavailable=(), order=None):
    return spark.createDataFrame([(1, p, str(i), str(i), f"t{i}", i not in unavailable, i) for p, i in enumerate(order or range(n))], QUEUE)


def test_likes_page_has_placeholders_and_knows_more(spark):
    ids = likes(spark, *[f"{i}:77" for i in range(52)])
    known = spark.createDataFrame([(str(i), f"T{i}", "a", 1.0, True) for i in range(49)], "id string, title string, artist string, duration double, available boolean")
    page = library.likes_page(ids, known, 0).orderBy("pos").collect()
    assert [r.id for r in page] == [str(i) for i in range(50)]
    assert not page[49].available and page[49].title == "TRACK 49" and page[48].available
    assert [r.id for r in library.likes_page(ids, known, 1).orderBy("pos").collect()] == ["50", "51"]
    assert [library.like_totals(ids, p).first().more for p in (0, 1)] == [True, False]
    assert spark.range(1).select(library.has_more(0, 20, F.lit(21)), library.has_more(1, 20, F.lit(21)), library.has_more(0, 20, F.lit(-1))).first()[:] == (True, False, False)


def fold_likes(ids, changes):
    """The changes one by one."""
    out = list(ids)
    for _, _, track, album, liked, status in changes:
        base = track.split(":")[0]
        if status != "confirmed" or not all(p.isascii() and p.isdigit() for p in track.split(":")) or len(track.split(":")) > 2:
            continue
        there = [x for x in out if x.split(":")[0] == base]
        if liked and not there:
            out.insert(0, track if ":" in track else f"{base}:{album}" if album else base)
        elif not liked:
            out = [x for x in out if x not in there]
    return out


@pytest.mark.parametrize("changes", [
    [(1, 1, "1", None, False, "confirmed"), (1, 2, "3", "33", True, "confirmed"), (1, 3, "3", "33", True, "confirmed")],
    [(1, 1, "1", None, True, "confirmed"), (1, 2, "2", None, False, "confirmed"), (1, 3, "2", "9", True, "confirmed"), (1, 4, "4:5", None, True, "confirmed")],
    [(1, 1, "7", None, True, "confirmed"), (1, 2, "7", None, False, "confirmed"), (1, 3, "8", None, True, "failed"), (1, 4, "../no", None, True, "confirmed")],
    [(1, 1, "5", None, True, "confirmed"), (1, 2, "6", None, True, "confirmed"), (1, 3, "5", "1", True, "confirmed")],
])
def test_likes_merge_equals_one_by_one(spark, changes):
    ids = ["1:11", "2:22"]
    assert in_order(library.likes_merge(likes(spark, *ids), spark.createDataFrame(changes, CHANGE)), "full_id") == fold_likes(ids, changes)


def test_pending_changes_win_and_failed_ones_never_were(spark):
    shown = lambda status: sorted(r.base for r in library.likes_overlay(likes(spark, "1", "2"), spark.createDataFrame([(1, 1, "1", None, False, status), (1, 2, "3", None, True, "pending")], CHANGE)).collect())
    assert shown("pending") == ["2", "3"]
    assert shown("failed") == ["1", "2", "3"]


def test_track_ids(spark):
    bad = ["../no", "1:bad", "1:", ":11", "1:11:22", "٣", None, ""]
    rows = spark.createDataFrame([(x,) for x in [*bad, "1", "1:2"]], "x string").select(expr.is_track_id("x")).collect()
    assert [r[0] for r in rows] == [False] * len(bad) + [True, True]
    with pytest.raises(expr.InvalidQuery):
        expr.check_query("  ", "all")
    with pytest.raises(expr.InvalidQuery):
        expr.check_query("x" * 301, "all")


def test_page_merge_keeps_the_first(spark):
    rows = spark.createDataFrame([(1, 0, 0, None, "track", "0", ""), (1, 1, 0, None, "track", "0", ""), (1, 1, 1, None, "track", "1", "")], "list_id long, page int, pos int, key string, kind string, id string, section string")
    assert in_order(library.page_merge(rows), "id", by="at") == ["0", "1"]


def test_neighbours_skip_what_is_unavailable(spark):
    rows = {r.pos: (r.next_pos, r.previous_pos) for r in sequence.neighbours(queue(spark, 5, {1, 3})).collect()}
    assert rows == {0: (2, -1), 1: (2, 0), 2: (4, 0), 3: (4, 2), 4: (-1, 2)}


def test_shuffle_off_restores_the_tail(spark):
    shuffled = queue(spark, 60, order=[0, *range(59, 0, -1)])
    at = spark.createDataFrame([(1, 1)], "seq_id long, cur int")
    assert in_order(sequence.restore_order(shuffled, at), "id", by="new_pos") == ["0", "59", *[str(i) for i in range(1, 59)]]
    drawn = in_order(sequence.shuffle_rest(queue(spark, 60), at, 7), "id", by="new_pos")
    assert drawn[:2] == ["0", "1"] and sorted(drawn) == sorted(str(i) for i in range(60)) and drawn != [str(i) for i in range(60)]
    again = in_order(sequence.wrap_around(queue(spark, 2), spark.createDataFrame([(1, 1)], "seq_id long, cur int"), 3), "id", by="new_pos")
    assert again[0] == "0"


def test_queue_start_moves_past_unavailable_rows(spark):
    wanted = spark.createDataFrame([(1, "1", False)], "seq_id long, id string, shuffled boolean")
    assert sequence.start_position(queue(spark, 4, {1, 2}), wanted).first().start_pos == 3


def test_queue_build_is_distinct_on_full_ids(spark):
    ids = spark.createDataFrame([(1, 0, "5:1"), (1, 1, "6"), (1, 2, "5:1"), (1, 3, "5:2")], "seq_id long, pos int, full_id string")
    loaded = spark.createDataFrame([("6", "six", False, "track"), ("5", "five", True, "album")], "id string, title string, available boolean, kind string")
    rows = sequence.queue_build(ids, loaded).orderBy("pos").collect()
    assert [(r.full_id, r.title, r.available, r.base_pos) for r in rows] == [("5:1", "TRACK 5", True, 2), ("6", "six", False, 1), ("5:2", "TRACK 5", True, 2)]


def test_history_fold(spark):
    actions = [("start", "45"), ("previous", "44"), ("previous", "43"), ("forward", None), ("forward", None)]
    rows = spark.createDataFrame([(1, i, a, x) for i, (a, x) in enumerate(actions)], "seq_id long, n int, action string, id string")
    r = sequence.history_fold(rows).first()
    assert (list(r.history), r.cursor) == (["43", "44", "45"], 2)
    jump = [("start", "45"), ("start", "52"), ("previous", None), ("start", "60")]
    r = sequence.history_fold(spark.createDataFrame([(1, i, a, x) for i, (a, x) in enumerate(jump)], rows.schema)).first()
    assert (list(r.history), r.cursor) == (["45", "60"], 1)


def test_history_fold_takes_all_actions_of_a_session(spark):
    rows = spark.range(12_000).selectExpr("id % 12000 AS n", "IF(id < 11990, 'start', 'previous') AS action", "IF(id < 11990, CAST(id AS STRING), NULL) AS id").selectExpr("1 AS seq_id", "n", "action", "id")
    r = sequence.history_fold(rows).first()
    assert list(r.history) == [str(i) for i in range(11_990)] and r.cursor == 11_979



def test_station_groups(spark):
    s = spark.createDataFrame([("genre:rock", "", "Rock", 0), ("genre:regional_child", "genre:children", "Child", 1), ("unknown:other", "", "Other", 2)], "id string, parent_id string, title string, pos int")
    pins = spark.createDataFrame([(1, "genre:rock", 0)], "account long, id string, pos int")
    hidden = spark.createDataFrame([(1, "genre:regional_child")], "account long, id string")
    recent = spark.createDataFrame([(1, "genre:regional_child", 3, 9.0)], "account long, id string, count long, last double")
    rows = catalog.station_groups(s, pins, hidden, recent).orderBy("group_ord").collect()
    assert [(r.group, r.id) for r in rows] == [("PINNED", "genre:rock"), ("KIDS", "genre:regional_child"), ("OTHER", "unknown:other")]
    assert [r.id for r in catalog.station_search(s, " CHI ").collect()] == ["genre:regional_child"]


def test_listening_time_counts_intervals_that_began_playing(spark):
    ticks = [(10.0, True), (10.5, False), (30.0, True), (31.0, False), (32.0, True), (32.4, False)]
    rows = spark.createDataFrame([(1, float(t), i, p) for i, (t, p) in enumerate(ticks)], "account long, t double, event_id int, playing boolean").withColumn("at", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
    assert listening.listening_time(rows).first().milliseconds == 500 + 1000 + 400


def test_retention_and_ratings(spark):
    e = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00"), (1, 2, "2024-03-31 00:00:00"), (1, 3, "2024-01-02 00:00:00")], "account long, event_id long, at string").withColumn("at", F.col("at").cast("timestamp"))
    kept = listening.retained(e, "2024-04-01 00:00:00", 90, 5000)
    assert sorted(r.event_id for r in kept.collect()) == [2, 3]
    c = spark.createDataFrame([(1, "a", 1, 1), (1, "a", 0, 2), (1, "b", -2, 1), (1, "b", 1, 3)], "account long, id string, value int, event_id long").withColumn("at", F.timestamp_seconds("event_id"))
    assert [(r.id, r.value) for r in listening.ratings(c).collect()] == [("b", 1)]


def mix_rows(spark):
    rows = [(1, i, str(i), "liked" if i < 20 else "artist", f"t{i}", [{"id": str(i % 12), "title": "x"}], "", True) for i in range(60)]
    rows += [(1, 60, "1", "artist", "again", [{"id": "1", "title": "x"}], "", True), (1, 61, "2", "artist", "gone", [{"id": "2", "title": "x"}], "", False)]
    return spark.createDataFrame(rows, f"account long, pos int, id string, origin string, title string, artists {tables.ARTISTS}, album_id string, available boolean")


def test_mix_invariants(spark):
    liked = spark.createDataFrame([(1, str(i)) for i in range(20)], "account long, id string")
    events = spark.createDataFrame([(1, "4", 99, 10.0, "finished", 1), (1, "9", 0, 5.0, "manual-skip", 2)], "account long, id string, t int, seconds double, cause string, event_id long").withColumn("at", F.timestamp_seconds("t"))
    rated = spark.createDataFrame([(1, "3", -2), (1, "55", 1)], "account long, id string, value int")
    found = recommend.features(mix_rows(spark), liked, events, rated, "1970-01-01 00:01:40")
    picks = recommend.greedy(recommend.scored(found, 0.5, 1)).orderBy("pick").collect()
    ids = [r.id for r in picks]
    artists = [int(i) % 12 for i in ids]
    assert len(ids) == len(set(ids)) == 30 and not {"3", "4"} & set(ids) and ids[0] == "55"
    assert all(a != b for a, b in zip(artists, artists[1:])) and max(map(artists.count, artists)) <= 3
    assert ids == [r.id for r in recommend.greedy(recommend.scored(found, 0.5, 1)).orderBy("pick").collect()]


def test_greedy_equals_a_plain_loop(spark):
    import random

    rng = random.Random(4)
    rows = [(a, str(i), round(rng.random(), 3), sorted({str(rng.randrange(9)) for _ in range(rng.randrange(3))}), "R") for a in range(30) for i in range(rng.randrange(40))]
    df = spark.createDataFrame(rows, "account long, id string, score double, artists array<string>, reason string")
    got = {}
    for r in recommend.greedy(df).orderBy("account", "pick").collect():
        got.setdefault(r.account, []).append(r.id)
    for a in range(30):
        left = sorted([r for r in rows if r[0] == a], key=lambda r: (-r[2], r[1]))
        picked, used, last = [], {}, set()
        while len(picked) < 30:
            best = next((r for r in left if not set(r[3]) & last and all(used.get(x, 0) < 3 for x in r[3])), None)
            if best is None:
                break
            left.remove(best)
            picked.append(best[1])
            last = set(best[3])
            for x in last:
                used[x] = used.get(x, 0) + 1
        assert got.get(a, []) == picked


def test_url_rule(spark):
    hosts = ["img.example.com", "cdn.example.com"]
    cases = {"img.example.com/a/%%": "https://img.example.com/a/300x300", "https://cdn.example.com/x": "https://cdn.example.com/x", "file:///etc/passwd": "", "https://evil.example.org/": "", "https://u@img.example.com/": "", "https://img.example.com/?q": "", "https://img.example.com:444/": "", None: None, "": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "u string").select("u", expr.allowed_url("u", hosts).alias("v")).collect()
    assert {r.u: r.v for r in rows if r.u is not None} == {k: v for k, v in cases.items() if k is not None}
    assert [r.v for r in rows if r.u is None] == [""]


def test_best_variant_and_truncation(spark):
    v = spark.createDataFrame([("a", 0, "mp3", True, 320), ("a", 1, "mp3", False, 192), ("a", 2, "aac", False, 192), ("b", 0, "flac", False, 900)], "id string, pos int, codec string, preview boolean, bitrate int")
    assert [tuple(r) for r in media.best_variant(v).collect()] == [("a", 192, 1, "mp3")]
    r = spark.createDataFrame([(94.0, 100.0), (95.0, 100.0), (10.0, 14.0), (0.0, 100.0), (None, 1.0)], "v double, e double").select(expr.is_truncated("v", "e")).collect()
    assert [x[0] for x in r] == [True, False, False, False, False]


def test_clock_and_fold(spark):
    r = spark.createDataFrame([(61.9,), (-5.0,), (None,), (3600.0,)], "s double").select(expr.clock("s")).collect()
    assert [x[0] for x in r] == ["1:01", "0:00", "0:00", "60:00"]
    assert spark.range(1).select(expr.contains_folded(F.lit("Straße"), "STRASSE")).first()[0]


def test_track_model_defaults(spark):
    raw = spark.createDataFrame([(7, "", [{"id": 0, "name": "x"}, {"id": 5, "name": ""}], None, None, None, None)], "id int, title string, artists array<struct<id:int,name:string>>, albums array<struct<id:int,title:string>>, duration_ms long, available boolean, cover string")
    t = tables.track_rows(tables.track_model(raw)).first()
    assert (t.id, t.title, t.artist, t.duration, t.available, t.album_id, t.detail) == ("7", "UNTITLED", "x", 0.0, False, "", "x")
    assert [(a.id, a.title) for a in t.artists] == [("5", "UNKNOWN")]


def test_json_objects(spark, tmp_path):
    for name, text in {"a": '{"enabled": true}', "b": "{bad", "c": "[1]"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = tables.json_objects(spark, str(tmp_path), "enabled boolean").collect()
    assert sorted(str(r.enabled) for r in rows) == ["None", "None", "True"]
    tables.write_json(spark.createDataFrame([("k", 1)], "account string, n int"), str(tmp_path / "out"), ["account"])
    tables.write_json(spark.createDataFrame([("k", 2)], "account string, n int"), str(tmp_path / "out"), ["account"])
    assert [tuple(r) for r in tables.read_json(spark, str(tmp_path / "out"), "n int, account string").collect()] == [(2, "k")]
    assert tables.read_json(spark, str(tmp_path / "none"), "n int").count() == 0


def test_audit(spark):
    docs = spark.createDataFrame([(1, "x\n-----BEGIN RSA PRIVATE KEY-----\npassword = 'abcd'"), (2, "a\0b"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.category, r.line) for r in audit.secret_lines(docs).collect()) == [(1, "CREDENTIAL", 3), (1, "PRIVATE_KEY", 2), (2, "BINARY", 0)]
    old = spark.createDataFrame([("o", "status", "playing"), ("o", "position", "1"), ("o", "gone", "x")], "object string, name string, value string")
    new = spark.createDataFrame([("o", "status", "paused"), ("o", "position", "2")], old.schema)
    assert [tuple(r) for r in audit.property_changes(old, new).collect()] == [("o", "status", "paused")]


def test_radio_dedup_and_feedback(spark, tmp_path):
    kind = "account long, station string, seq long, action string, batch string, track string, available boolean"
    first = [(1, "s", 1, "offer", "first", "0", True), (1, "s", 1, "offer", "first", "1", True), (1, "s", 2, "play", "first", "0", True), (1, "s", 3, "play", "first", "1", True)]
    second = [(1, "s", 4, "offer", "second", str(i), True) for i in range(4)]
    spark.createDataFrame(first + second, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = radio.drain(radio.wave_dedup(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"), ["seq", "action", "track"])
    offers = [(r.track, r.batch) for r in out.where("action = 'offer'").orderBy("seq", "track").collect()]
    assert offers == [("0", "first"), ("1", "first"), ("2", "second"), ("3", "second")]
    kind = "account long, seq long, track string, signal string"
    signals = [(1, 0, None, "radio"), (1, 1, "0", "started"), (1, 1, "0", "started"), (1, 2, "0", None), (1, 3, "0", "who knows"), (1, 5, "0", "manual-skip"), (1, 6, "0", "finished"), (1, 7, "1", "started")]
    spark.createDataFrame(signals, kind).coalesce(1).write.parquet(str(tmp_path / "in2"))
    out = radio.drain(radio.wave_feedback(spark.readStream.schema(kind).parquet(str(tmp_path / "in2"))), str(tmp_path / "out2"), str(tmp_path / "ck2"), ["seq", "track", "event"])
    assert [(r.track, r.event, r.seconds) for r in out.orderBy("seq").collect()] == [(None, "radioStarted", 0), ("0", "trackStarted", 0), ("0", "skip", 4), ("1", "trackStarted", 0)]
    provider = "spark.sql.streaming.stateStore.providerClass"
    assert spark.conf.get(provider, None) != radio.ROCKSDB


def test_retention_as_state(spark, tmp_path):
    kind = "account long, at timestamp, play string"
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    rows = [(1, day(0), "a"), (1, day(60), "b"), (1, day(91), "c"), (1, None, "x"), (2, None, "y"), (3, day(1), "d"), (3, day(2), None), (3, day(3), "e"), (3, day(4), "f")]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    out = radio.drain(radio.retained(stream, most=3), str(tmp_path / "out"), str(tmp_path / "ck"), ["account"], "update")
    assert sorted((r.account, r.kept, r.oldest) for r in out.collect()) == [(1, 2, day(60)), (3, 3, day(2))]


def test_radio_rows_and_station_counts(spark):
    rows = sequence.radio_rows(spark.createDataFrame([(1, "a")], "seq_id long, id string"), spark.createDataFrame([(1, 0, "b"), (1, 1, "c")], "seq_id long, pos int, id string"))
    assert in_order(rows, "pos", "id", "is_current") == [(-1, "a", True), (0, "b", False), (1, "c", False)]
    starts = spark.createDataFrame([(1, "s", 3), (1, "s", 5), (1, "t", 4)], "account long, station string, at long")
    assert sorted(map(tuple, radio.recent_station_counts(starts).collect())) == [(1, "s", 2, 5), (1, "t", 1, 4)]


def test_previous_at_the_first_entry_prepends_the_predecessor(spark):
    steps = [(1, 1, "start", "45"), (1, 2, "previous", "44"), (1, 3, "previous", "43"), (1, 4, "previous", None), (1, 5, "forward", None), (1, 6, "forward", None), (1, 7, "start", "9")]
    for n, want in ((3, (["43", "44", "45"], 0)), (4, (["43", "44", "45"], 0)), (6, (["43", "44", "45"], 2)), (7, (["43", "44", "45", "9"], 3))):
        r = sequence.history_fold(spark.createDataFrame(steps[:n], "seq_id long, n int, action string, id string")).first()
        assert (r.history, r.cursor) == want


def test_snapshots_listings_and_frozen_trees(spark, tmp_path):
    files = spark.createDataFrame([("b",), ("a",), ("b",)], "path string")
    assert in_order(audit.distinct_files(files), "path", by="path") == ["a", "b"]
    for _ in range(2):
        audit.write_snapshot(files.withColumnRenamed("path", "line"), str(tmp_path / "snap"))
        assert [r.value for r in spark.read.text(str(tmp_path / "snap")).collect()] == ["a", "b"]
    none = files.limit(0)
    assert audit.is_frozen(none, none) and not audit.is_frozen(none, files)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/y.txt", "12345")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("in/tar")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "c.bin").write_bytes(b"no archive")
    archives = spark.read.format("binaryFile").load([str(tmp_path / x) for x in ("a.zip", "b.tar.gz", "c.bin")])
    assert sorted((r.archive.rsplit("/", 1)[1], r.entry, r.size) for r in audit.archive_listing(archives).collect()) == [("a.zip", "x/y.txt", 5), ("b.tar.gz", "in/tar", 3)]


def test_findings_reach_over_lines(spark):
    text = "a\npassword:\n  'abcd'\nx\npassword: 'efgh' cookie = \"1234\"\n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.line) for r in audit.secret_lines(docs).collect()) == [(1, 2), (1, 5), (1, 5)]


def test_json_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "state")
    tables.write_json(spark.createDataFrame([(1,)], "n int"), path)
    with pytest.raises(Exception):
        tables.write_json(spark.range(1).select(F.raise_error(F.lit("no")).alias("n")), path)
    assert tables.read_json(spark, path, "n int").first().n == 1
    tables.write_json(spark.createDataFrame([(2,), (3,)], "n int"), path)
    assert sorted(r.n for r in tables.read_json(spark, path, "n int").collect()) == [2, 3]
    assert os.stat(path).st_mode & 0o777 == 0o700


def test_folders_per_account_and_paths(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "likes")
    tables.write_by_account(spark.createDataFrame([("u1", 1), ("u2", 2)], "account string, n int"), path)
    tables.write_by_account(spark.createDataFrame([("u1", 5)], "account string, n int"), path)
    rows = spark.read.parquet(path).collect()
    assert sorted((r.account, r.n) for r in rows) == [("u1", 5), ("u2", 2)]
    assert {r.account_key for r in rows if r.account == "u1"} == {hashlib.sha256(b"u1").hexdigest()[:32]}
    assert tables.data_path(spark, "cache", "x.json", "/var/c/") == "/var/c/x.json"
    spark.conf.set("tessitura.path.cache", "/set")
    assert tables.data_path(spark, "cache", "x.json", "/var/c/") == "/set/x.json"
    monkeypatch.setenv("TESSITURA_CACHE", "/env")
    assert tables.data_path(spark, "cache", "x.json", "/var/c/") == "/env/x.json"
    spark.conf.unset("tessitura.path.cache")


def test_rounding_follows_the_binary_value(spark):
    values = [2.675, 0.125, 0.375, 1.005, 1.115, -2.675, -0.125, 0.0, 1e9 + 0.125, 33.335, *[i * 0.005 for i in range(2000)], *[i / 8 for i in range(-50, 50)]]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", expr.round_2("x").alias("y"), expr.iso_utc(F.timestamp_micros(F.lit(1_704_067_199_000_001))).alias("t"), expr.play_id().alias("u")).collect()
    assert [r.y for r in got] == [round(r.x, 2) for r in got]
    assert got[0].t == "2023-12-31T23:59:59.000001+00:00" and len({r.u for r in got}) == len(got) and uuid.UUID(got[0].u).version == 4


def test_damaged_archives_end_no_job(spark):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as t:
        for n in range(40):
            info = tarfile.TarInfo(f"f{n}")
            info.size = 5000
            t.addfile(info, io.BytesIO(os.urandom(5000)))
    tar, packed = buffer.getvalue(), io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for n in range(5):
            z.writestr(f"z{n}", "x" * 100)
    whole = packed.getvalue()
    broken = whole[: whole.rfind(b"PK\x01\x02")] + b"PK\x09\x09" + whole[whole.rfind(b"PK\x01\x02") + 4 :]
    import bz2
    import lzma

    rows = [("tar", tar), ("cut", tar[: len(tar) // 2]), ("zip", whole), ("broken", broken), ("half", whole[:200]), ("xz", lzma.compress(b"a" * 2000)[:40]), ("bz2", bz2.compress(os.urandom(9000))[:3000]), ("gz", b"\x1f\x8b\x08" + b"\0" * 40), ("none", None), ("empty", b"")]
    got = audit.archive_listing(spark.createDataFrame(rows, "path string, content binary")).groupBy("archive").count().collect()
    counts = {r.archive: r["count"] for r in got}
    assert counts["tar"] == 40 and counts["zip"] == 5 and 0 < counts.get("cut", 0) < 40 and not counts.keys() & {"half", "xz", "bz2", "gz", "none", "empty"}


def test_lines_of_many_findings(spark):
    text = "\n".join(f"line {i}\npassword =\n 'secret{i}'" for i in range(20_000))
    rows = audit.secret_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [r.line for r in rows] == [3 * i + 2 for i in range(20_000)]


def test_entity_ids_are_digits_of_any_script(spark):
    import sys

    rows = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (chr(c).isalnum() or c < 128)] + ["12٣", "1a", "1\n", "", " 1", "۴۵", "1²", None]
    got = spark.createDataFrame([(x,) for x in rows], "x string").select("x", expr.is_entity_id("x").alias("d")).collect()
    assert [r.x for r in got if r.d != (r.x or "").isdigit()] == []


def test_every_account_meets_the_whole_catalogue(spark):
    accounts = spark.range(7).withColumnRenamed("id", "account")
    stations = spark.range(25).selectExpr("CAST(id AS STRING) AS id")
    want = {(a, str(i)) for a in range(7) for i in range(25)}
    for broadcast_rows, part_rows in ((50, 10_000), (0, 10_000), (0, 4), (50, 4)):
        rows = [tuple(r) for r in catalog.with_every(accounts, stations, broadcast_rows, part_rows).select("account", "id").collect()]
        assert len(rows) == len(want) and set(rows) == want
    assert catalog.with_every(accounts, stations.limit(0)).count() == 0


def test_loose_objects_are_read_and_scanned(spark, tmp_path):
    import zlib

    contents = [("blob", b"password = 'abcdef'"), ("blob", b"\xff\xfe\npassword = 'abcdef'"), ("commit", b"author x\n\ncookie='12345678'"), ("blob", b"image password = 'abcdef'"), ("tree", b"password = 'abcdef'")]
    names = {}
    for n, (kind, body) in enumerate(contents):
        raw = f"{kind} {len(body)}".encode() + b"\0" + body
        digest = hashlib.sha1(raw).hexdigest()
        names[digest] = f"f{n}.PNG" if body.startswith(b"image") else f"f{n}"
        (tmp_path / digest[:2]).mkdir(exist_ok=True)
        (tmp_path / digest[:2] / digest[2:]).write_bytes(zlib.compress(raw))
    (tmp_path / "ab").mkdir(exist_ok=True)
    (tmp_path / "ab" / ("c" * 38)).write_bytes(b"damaged")
    (tmp_path / "ab" / ("d" * 38)).write_bytes(zlib.compress(b"blob 9\0short"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    objects = audit.loose_objects(files)
    assert {r.object: r.kind for r in objects.collect()} == {d: contents[n][0] for n, d in enumerate(names)}
    named = objects.join(spark.createDataFrame(list(names.items()), "object string, name string"), "object")
    lines = {names[r.object]: r.line for r in audit.object_findings(named).collect()}
    assert lines == {"f0": 1, "f1": 2, "f2": 3}
    counts = {r.kind: (r.scanned, r.images, r.findings) for r in audit.audit_counts(named, audit.object_findings(named)).collect()}
    assert counts == {"blob": (3, 1, 2), "commit": (1, 0, 1), "tree": (1, 0, 0)}
