"""SimHash fingerprints, links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from tessitura.llm.graph import components
from tessitura.llm.simhash import drop_near_duplicates, fingerprint, forest, jaccard_components, near_links, run_links, run_pairs, simhash_components


def plain_fingerprint(text, n=4):
    words = [w for w in __import__("re").split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \t\n", "One", "one TWO three", "a b c d", "Ünï ÇÖDE \x0b x\x0cy z\rq É", "same same same same same same", "a b c d e", " ".join(map(str, range(500)))])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def brute_components(prints, most=4):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= most:
                root[find(a)] = find(b)
    return {f: find(f) for f in prints}


def groups(pairs):
    out = {}
    for node, root in pairs:
        out.setdefault(root, set()).add(node)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("block", [2048, 3])
def test_links_connect_all_near_fingerprints(spark, block):
    rng = random.Random(block)
    prints = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 25)):
            prints.add(f)
            for _ in range(rng.randrange(7)):
                f ^= 1 << rng.randrange(64)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    links = near_links(spark.createDataFrame([x * 2 for x in signed], "node long, fp0 long"), block=block)
    found = {r.node: r.root for r in components(links).collect()}
    want = brute_components(prints)
    mine = {x: found.get(x - (1 << 64) if x >> 63 else x, x - (1 << 64) if x >> 63 else x) for x in prints}
    assert groups(mine.items()) == groups(want.items())


def test_run_links_stay_in_their_run():
    key = np.array([1, 1, 2, 2, 2])
    fp = np.array([0, 1, 0, 3, 1 << 40 | 255], np.uint64)
    a, b = run_links(key, np.array([10, 11, 12, 13, 14]), fp[:, None], 2)
    assert sorted(zip(a.tolist(), b.tolist())) == [(11, 10), (13, 12)]


def test_components_of_chains_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 101), (7, 7)]
    rows = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert rows == {i: 0 for i in range(51)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    body = " ".join(f"w{i}" for i in range(300))
    rows = [(5, body), (3, body + " more"), (9, None), (8, ""), (1, "other text altogether here"), (None, body), (5, body)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, fp int")
    got = simhash_components(df).select("doc_id", "fingerprint", "component_id").collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    want = {t: plain_fingerprint(t or "") for _, t in rows}
    near = (want[body] ^ want[body + " more"]).bit_count() <= 4
    assert by[5, f"{want[body]:016x}"] == (3 if near else 5)
    assert by[9, "0" * 16] == by[8, "0" * 16] == 8 and by[1, f"{want['other text altogether here']:016x}"] == 1
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and 9 not in [r.doc_id for r in kept.collect()]
    assert {5, 3} - {r.doc_id for r in kept.collect()} == {5}
    assert simhash_components(df.limit(0)).count() == 0


def test_small_table_has_the_components_of_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    prints = {r.doc_id: plain_fingerprint(r.text or "") for r in docs.collect()}
    roots = brute_components(set(prints.values()))
    least = {}
    for k, f in prints.items():
        least[roots[f]] = min(k, least.get(roots[f], k))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(docs).collect()} == {k: (f"{f:016x}", least[roots[f]]) for k, f in prints.items()}


def test_wide_fingerprints_find_near_copies_and_spare_others(spark):
    rng = random.Random(8)
    texts, pairs = [], []
    for i in range(60):
        words = [f"{rng.randrange(3000)}" for _ in range(rng.randrange(80, 400))]
        texts.append(" ".join(words))
        if i % 2:
            for at in rng.sample(range(len(words)), max(1, len(words) // 80)):
                words[at] = "changed"
            pairs.append((len(texts) - 1, len(texts)))
            texts.append(" ".join(words))
    shared = " ".join(f"p{j}" for j in range(60))
    texts += [f"{shared} " + " ".join(f"{rng.randrange(3000)}" for _ in range(120)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in drop_near_duplicates(df).collect()}
    assert sum(b not in kept for _, b in pairs) >= 0.9 * len(pairs)
    assert all(i in kept for i in range(len(texts)) if i not in {b for _, b in pairs})


def near_texts():
    """Texts around a similarity of 0.8, chains, copies, texts that share one much repeated line, short and empty ones."""
    rng = random.Random(3)
    line = " ".join(f"l{j}" for j in range(14))
    texts = ["", " ", "a b", "A  b", "a b c"]
    for _ in range(60):
        words = [f"{rng.randrange(5000)}" for _ in range(rng.randrange(30, 300))]
        for _ in range(rng.randrange(1, 5)):
            texts.append(" ".join(words))
            for at in rng.sample(range(len(words)), max(1, int(len(words) * rng.uniform(0.015, 0.03)))):
                words[at] = f"c{rng.randrange(10**6)}"
    texts += [" ".join([line] * 40 + [f"{rng.randrange(5000)}" for _ in range(200)]) for _ in range(8)]
    return texts


def jaccard_roots(texts, least=0.8):
    def shingles(t, n=5):
        w = t.lower().split()
        return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or {" ".join(w)}

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return root


def test_near_duplicates_are_the_components_of_brute_force_jaccard(spark):
    texts = near_texts()
    root = jaccard_roots(texts)
    assert len(set(root)) < len(root) - 20 and all(root[-i] == len(texts) - i for i in range(1, 9))
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    found = {r.node: r.root for r in jaccard_components(df).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == root
    kept = {r.doc_id for r in drop_near_duplicates(df.withColumnRenamed("node", "doc_id")).collect()}
    assert kept == set(root)


def test_null_and_repeated_keys_stand_for_no_other_row(spark):
    rng = random.Random(5)
    body = [" ".join(str(rng.randrange(10**6)) for _ in range(100)) for _ in range(4)]
    rows = [(1, body[0], "a"), (None, body[0] + " x", "b"), (None, body[1], "c"), (None, body[2], "d"), (None, body[2] + " x", "e"), (7, body[0] + " y", "f"), (7, body[3], "g"), (9, body[3] + " x", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string").coalesce(1)
    assert {r.tag for r in drop_near_duplicates(df).collect()} == {"a", "c", "d", "g"}


@pytest.mark.parametrize("size", [3, 40, 900])
def test_the_bound_on_bitmaps_leaves_no_similar_pair_out(size):
    """Sets of about ``size`` shingles around the similarity: every pair at 0.8 or more goes on, and few of those far below."""
    import pyarrow as pa

    from tessitura.llm.simhash import _between_trees

    rng = np.random.default_rng(size)
    base = rng.integers(0, 2**62, size)
    sets = [set(np.where(rng.random(size) < rng.choice([0.02, 0.1, 0.3]), rng.integers(0, 2**62, size), base).tolist()) for _ in range(80)]
    maps = []
    for s in sets:
        flags = np.zeros(4096, np.uint8)
        flags[[x % 4096 for x in s]] = 1
        maps.append((int(flags.sum()), np.packbits(flags).tobytes()))
    numbers = [pa.array(x, pa.int64()) for x in ([7] * 80, range(80), map(len, sets), (m for m, _ in maps), range(80))]
    batch = pa.RecordBatch.from_arrays([*numbers, pa.array([b for _, b in maps], pa.binary())], names=["key", "node", "n", "marked", "tree", "bitmap"])
    found = {(a, b) for part in _between_trees(0.8)(iter([batch])) for a, b in zip(*(c.to_pylist() for c in part.columns))}
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(80) for j in range(i)}
    assert {p for p, x in alike.items() if x >= 0.8} <= found
    assert size != 40 or not [p for p in found if alike[p] < 0.65]


def test_the_pipelines_candidates_are_those_of_the_variants(spark, monkeypatch):
    from tessitura.llm import simhash

    words, verified = [], []
    own, jaccard = simhash.word_links, simhash.jaccard_links
    monkeypatch.setattr(simhash, "word_links", lambda rows, word, *a, **k: words.append(word) or own(rows, word, *a, **k))
    monkeypatch.setattr(simhash, "jaccard_links", lambda *a, **k: verified.append(jaccard(*a, **k)) or verified[-1])
    texts = near_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    simhash.jaccard_components(df)
    root = jaccard_roots(texts)
    assert words == ["fp0", "fp1"] and verified[0].count() > 0.5 * (len(root) - len(set(root)))


def test_pairs_of_a_run_are_real_connect_it_and_grow_with_it():
    rng = np.random.default_rng(1)
    for size in (50, 500):
        bits = np.uint64(1) << rng.integers(0, 64, (size, 2)).astype(np.uint64)
        fp = np.stack([np.bitwise_xor.reduce(bits, axis=1), np.zeros(size, np.uint64)], axis=1)
        key, node = np.repeat([1, 2], size), np.tile(np.arange(size), 2)
        for held in (1 << 20, 100):
            a, b = run_pairs(key, node, np.concatenate([fp, fp]), 4, node - size * key, held)
            assert len(a) == 2 * (size - 1) and (np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1) <= 4).all()
            assert len(forest(a, b)[0]) == size - 1
    assert [len(x) for x in run_pairs(key, node, np.concatenate([fp, fp]), 4, key)] == [0, 0]
