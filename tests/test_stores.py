"""The split history fold, the versioned likes, and the search index against plain versions."""

import random

import numpy as np
import pytest

from tessitura.operators import history, library, search, sequence
from tessitura.operators.history import BACK, FORWARD, NOTHING, PREPEND, START
from tessitura.sources.likes import LikeStore
from tessitura.sources.versions import StaleVersion, pointer

ACTION = "seq_id long, n int, action string, id string"


def plain_history(moves):
    entries, cursor = [], -1
    for move, track in moves:
        if move == START:
            entries = [*entries[: cursor + 1], track]
            cursor = len(entries) - 1
        elif move in (PREPEND, BACK) and cursor > 0:
            cursor -= 1
        elif move == PREPEND:
            entries, cursor = [track, *entries], 0
        elif move == FORWARD and cursor + 1 < len(entries):
            cursor += 1
    return entries, cursor


@pytest.mark.parametrize("seed", range(400))
def test_blocks_chain_to_the_whole_fold(seed):
    rng = random.Random(seed)
    weights = [rng.random() for _ in range(4)]
    moves = [(rng.choices(range(4), weights)[0], str(k)) for k in range(rng.randrange(60))]
    cuts = sorted(rng.randrange(len(moves) + 1) for _ in range(rng.randrange(7)))
    state, parts = NOTHING, []
    for block in [moves[a:b] for a, b in zip([0, *cuts], [*cuts, len(moves)], strict=True)]:
        codes = np.array([m for m, _ in block], np.int64)
        parts.append(history.folded(state, codes.tolist(), [i for _, i in block]))
        want = state
        for m in codes.tolist():
            want = history.moved(*want, m)
        state = history.after(state, *history.summary(codes))
        assert state == want or (state[2] < state[1] and want[2] < want[1])
    entries = {}
    for n, (own, _) in enumerate(parts):
        low = min((cut for _, cut in parts[n + 1 :]), default=1 << 62)
        entries |= {p: i for p, i in own.items() if p < low}
    cursor = -1 if state[2] < state[1] else state[0] - state[1]
    assert ([entries[p] for p in sorted(entries)], cursor) == plain_history(moves)


def test_split_sessions_equal_whole_ones(spark):
    rng = random.Random(4)
    rows = []
    for session, n in ((1, 3000), (2, 40), (3, 1), (4, 5), (5, 700)):  # one hot, some short
        for k in range(n):
            action = rng.choice(["start", "previous", "previous", "forward", "forward"] if session == 5 else ["start", "start", "previous", "forward", "unknown"])
            rows.append((session, k // 2, action, None if action == "previous" and rng.random() < 0.5 else str(rng.randrange(50))))
    rows += [(6, 1, "forward", None), (6, 2, "previous", None)]
    df = spark.createDataFrame(rows, ACTION)
    whole = sorted(map(tuple, sequence.whole_fold(df).collect()))
    for over in (1, 100):
        assert sorted(map(tuple, sequence.history_fold(df, over).collect())) == whole
    assert sequence.history_fold(df.limit(0), 1).count() == 0


LIKE = "account long, pos int, full_id string"
CHANGE = "account long, seq long, track_id string, album_id string, liked boolean, status string"


def shown(store, version=None):
    return [(r.account, r.pos, r.full_id) for r in store.likes(version).orderBy("account", "pos").collect()]


def test_likes_are_merged_bucket_by_bucket(spark, tmp_path):
    store = LikeStore(spark, str(tmp_path / "likes"), 8)
    first = spark.createDataFrame([(a, i, f"{i}:1") for a in range(12) for i in range(3)], LIKE)
    assert store.start(first) == 0
    with pytest.raises(StaleVersion):
        store.start(first)
    changes = spark.createDataFrame([(1, 1, "9", "5", True, "confirmed"), (1, 2, "0", None, False, "confirmed"), (2, 3, "7", None, True, "failed"), (3, 4, "x", None, True, "confirmed"), (1, 5, "0", None, True, "confirmed")], CHANGE)
    assert store.merge(changes) == 1
    assert [x[2] for x in shown(store) if x[0] == 1] == ["0", "9:5", "1:1", "2:1"] and [x for x in shown(store) if x[0] != 1] == [x for x in shown(store, 0) if x[0] != 1]
    before, after = (pointer(spark, store.path, v)[1]["folders"] for v in (0, 1))
    assert sum(before[b] != after[b] for b in before) == 1  # the buckets of other accounts are the same folders
    assert store.merge(spark.createDataFrame([(1, 6, "3", None, True, "pending")], CHANGE)) == 1
    with pytest.raises(StaleVersion):
        store.merge(spark.createDataFrame([(1, 5, "3", None, True, "confirmed")], CHANGE))
    assert store.merge(spark.createDataFrame([(1, 7, x, None, False, "confirmed") for x in ("0", "1", "2", "9")], CHANGE)) == 2
    assert not [x for x in shown(store) if x[0] == 1]
    assert store.roll_back(1) == 3 and shown(store) == shown(store, 1)
    assert store.merge(spark.createDataFrame([(1, 8, "4", None, True, "confirmed")], CHANGE)) == 4
    want = library.likes_merge(first, changes.unionByName(spark.createDataFrame([(1, 8, "4", None, True, "confirmed")], CHANGE)))
    assert shown(store) == [(r.account, r.pos, r.full_id) for r in want.orderBy("account", "pos").collect()]


def test_two_writers_lose_no_change(spark, tmp_path):
    store = LikeStore(spark, str(tmp_path / "likes"), 4)
    store.start(spark.createDataFrame([(a, 0, "1") for a in range(20)], LIKE))
    for n, accounts in enumerate(([1], range(20))):  # another bucket at most, then all of them
        other = LikeStore(spark, store.path)
        write = other._write

        def late(rows, count, n=n, accounts=accounts, write=write, other=other):
            if other._write is not write:
                other._write = write
                store.merge(spark.createDataFrame([(a, 10 * n + 1, f"{n}00{n}", None, True, "confirmed") for a in accounts], CHANGE))
            return write(rows, count)

        other._write = late
        other.merge(spark.createDataFrame([(19, 10 * n + 5, f"77{n}", None, True, "confirmed")], CHANGE))
    rows = {x[2] for x in shown(store) if x[0] == 19}
    assert rows == {"1", "770", "771", "1001"} and {x[2] for x in shown(store) if x[0] == 1} == {"1", "0000", "1001"}


def test_case_folding_of_every_letter(spark):
    letters = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    lines = ["".join(letters[i : i + 4096]) for i in range(0, len(letters), 4096)] + ["Straße", "ΣΑΣ", "İstanbul", "ﬃ", "", None]
    got = spark.createDataFrame([(x,) for x in lines], "t string").select("t", search.case_folded("t").alias("f")).collect()
    assert all(r.f == (None if r.t is None else r.t.casefold()) for r in got)


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(2)
    words = ["Straße", "STRASSE", "Größe", "ΣΑΣ", "σας", "a", "ab", "", "naïve", "𝕬𝖇𝖈", "%_", "aaa", "aaaa"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(5)))) for i in range(300)] + [(7, None), (8, "x" * 50_000 + "NEEDLE"), (9, "same"), (9, "SAME")]
    search.build_index(spark.createDataFrame(rows, "id long, title string"), str(tmp_path / "index"))
    for query in ("strasse", "ẞE", "ς", "", "a", "AAA", "aaaa a", "needle", "none of it", "𝕬𝖇𝖈", "%_", "Same", "e s"):
        got = sorted(((r.id, r.title) for r in search.search(spark, str(tmp_path / "index"), query).collect()), key=repr)
        assert got == sorted(((i, t) for i, t in rows if query.casefold() in (t or "").casefold()), key=repr)
