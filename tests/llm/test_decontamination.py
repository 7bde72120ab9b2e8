"""Greedy string tiling and contamination against plain versions."""

import random

import pytest

from tessitura.llm.decontamination import contaminated, drop_contaminated, tiles, words_of


def plain_tiles(a, b, least):
    """Greedy string tiling by definition: the longest common unmarked run, again and again; covered length of each round."""
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return out
        k, i, j = best
        out.append(k)
        for x in range(k):
            ma[i + x] = mb[j + x] = True


@pytest.mark.parametrize("seed", range(30))
def test_tiles_are_the_longest_first(seed):
    rng = random.Random(seed)
    a = [rng.randrange(6) for _ in range(rng.randrange(30))]
    b = [x for cut in [rng.randrange(len(a) + 1) for _ in range(4)] for x in a[cut : cut + rng.randrange(9)]] + [rng.randrange(6) for _ in range(6)]
    found = tiles(a, b, 3)
    assert all(a[p : p + k] == b[t : t + k] and k >= 3 for p, t, k in found)
    used = [p + i for p, _, k in found for i in range(k)], [t + i for _, t, k in found for i in range(k)]
    assert all(len(u) == len(set(u)) for u in used)
    want = plain_tiles(a, b, 3)
    assert max((k for *_, k in found), default=0) == max(want, default=0)
    assert sum(k for *_, k in found) >= 0.6 * sum(want)


def test_no_tile_is_left():
    found = tiles([1, 2, 3, 4, 5, 6], [4, 5, 6, 9, 1, 2, 3], 3)
    assert sorted(found) == [(0, 4, 3), (3, 0, 3)]


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_contaminated_documents(spark, limit):
    w = ITEM.split()
    moved = " ".join(w[6:] + ["and", "then"] + w[:6])
    docs = [(1, f"Intro. {ITEM.upper()}, outro"), (2, moved), (3, " ".join(w[:6]) + " rest of it"), (4, None), (5, ""), (6, "x " * 50_000 + ITEM), (None, ITEM), (7, "one two"), (7, "one two")]
    bench = [(10, ITEM), (11, "one two"), (12, ""), (13, None), (14, "nothing like this in any of the documents"), (None, ITEM)]
    d = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted((str(r.doc_id), str(r.item_id), r.coverage, r.n_tiles) for r in contaminated(d, b, broadcast_bytes=limit).collect())
    both = [(k, i, 1.0, n) for k, n in (("1", 1), ("2", 2), ("6", 1), ("None", 1)) for i in ("10", "None")]
    assert got == sorted(both + [("7", "11", 1.0, 1)] * 2)
    kept = drop_contaminated(d, b, broadcast_bytes=limit)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert contaminated(d.limit(0), b).count() == 0 and contaminated(d, b.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_clean_rows_stay_beside_leaks_of_their_key(spark, limit):
    rows = [(None, ITEM, 1, "f"), (None, "clean", 2, "f"), (7, ITEM, 3, "f"), (7, "clean too", 4, "f"), (8, None, 5, "f"), (8, None, 5, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __number int, __file string")
    kept = drop_contaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"), broadcast_bytes=limit)
    assert kept.columns == docs.columns and sorted((r["__number"] for r in kept.collect())) == [2, 4, 5, 5]
    assert drop_contaminated(docs.limit(0), spark.createDataFrame([(1, ITEM)], "item_id long, text string"), broadcast_bytes=limit).count() == 0
    assert drop_contaminated(docs, spark.createDataFrame([], "item_id long, text string"), broadcast_bytes=limit).count() == 6


def test_every_verbatim_item_of_the_small_table_is_found(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}
    verbatim = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if " ".join(words_of(i.text)) in " ".join(words_of(d.text))}
    assert verbatim and verbatim <= found and len(found) <= len(verbatim) + 2


def test_whole_result_is_that_of_plain_tiling(spark):
    sf = "/root/testdata/sf0.001"
    rng = random.Random(5)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for n, (_, text) in enumerate(items * 2):  # cut in pieces that change places, some of them lost, repeated or too short
        w = words_of(text)
        cuts = sorted({0, len(w), *(rng.randrange(len(w)) for _ in range(rng.randrange(6)))})
        parts = [w[a:b] for a, b in zip(cuts, cuts[1:])]
        rng.shuffle(parts)
        docs.append((10_000 + n, " Zz ".join(" ".join(p) for p in parts + parts[:1] if rng.random() < 0.9)))
    want = {}
    for key, text in docs:
        words = words_of(text or "")
        for item, passage in items:
            other = words_of(passage)
            least = min(5, len(other))
            grams = {tuple(other[i : i + least]) for i in range(len(other) - least + 1)}
            if least and any(tuple(words[i : i + least]) in grams for i in range(len(words) - least + 1)):
                covered = sum(plain_tiles(other, words, least))
                if covered / len(other) >= 0.8:
                    want[key, item] = covered / len(other)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for limit in (8 << 20, 0):
        got = {(r.doc_id, r.item_id): r.coverage for r in contaminated(d, b, broadcast_bytes=limit).collect()}
        assert len(want) > 20 and got.keys() == want.keys()
        assert sum(abs(got[x] - want[x]) > 1e-9 for x in want) <= len(want) / 20  # equally long runs may be taken in another order
