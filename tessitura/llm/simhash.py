"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in at most four bits,
one segment differs in at most one, so the two share a variant of that segment in which one bit is
a wildcard. Each distinct fingerprint enters the index once per bit: the position and the segment
without that bit. Equal variants are joined and each candidate is verified on all 64 bits.

Equal fingerprints are one row of the index, so groups of copies cost nothing. Tasks read the
index sorted by variant and emit, per run of equal variants, the links of a spanning forest, not
all pairs. A variant with more than ``block`` fingerprints is cut into blocks, and pairs of blocks
go to different tasks; no link is lost.

Fingerprints of several words have an index for each word by the same variants, and candidates are
verified on the bits of all words. What the first word connects is contracted to trees, and the
other words only emit links between different trees, so a large group is not linked anew by every
variant.

The pipeline's stage (:func:`drop_near_duplicates`) takes its candidates from the same variants, over
fingerprints of two words, and verifies each on the sets of word shingles themselves: it links at a
Jaccard similarity. Pairs that no variant finds are then looked for by prefixes of the sets, between
the trees found so far, so that no link is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, numbered, release, slices, small, spare, staged, texts, without
from .exact_dedup import from_files
from .graph import components

#: Bits of the three segments: first, one past the last.
SEGMENTS = ((0, 21), (21, 42), (42, 64))
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _ones(hashes: bytes, n: int, width: int) -> np.ndarray:
    """Bits that are set in over half of ``n`` hashes of ``width`` bits, as little-endian 64-bit words."""
    rows = np.frombuffer(hashes, np.uint8).reshape(n, width // 8)
    ones = np.zeros(width, np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(rows[at : at + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")


def shingles_of(text: str, words: int) -> list[bytes]:
    """All runs of ``words`` words, repeats included; a shorter text is one run, a text without words has none."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    whole = b" ".join(parts)
    if len(parts) < words:
        return [whole]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    stop = np.cumsum(size + 1) - 1
    start = (stop - size)[: len(parts) - words + 1]
    return [whole[a:b] for a, b in zip(start.tolist(), stop[words - 1 :].tolist(), strict=True)]


def fingerprint_words(text: str, words: int = 4, k: int = 1) -> np.ndarray:
    """SimHash of the word shingles of a text, repeats included, in ``k`` words of 64 bits; zero without words.

    One word is made of XXH64 with seed 42, several of XXH3-128 with seeds 42, 43, ...
    """
    shingles = shingles_of(text, words)
    if not shingles:
        return np.zeros(k, np.uint64)
    n = len(shingles)
    if k == 1:
        digest = partial(xxhash.xxh64_intdigest, seed=42)
        return _ones(np.fromiter(map(digest, shingles), "<u8", n).tobytes(), n, 64)
    halves = [_ones(b"".join(map(partial(xxhash.xxh3_128_digest, seed=42 + j), shingles)), n, 128) for j in range(-(-k // 2))]
    return np.concatenate(halves)[:k]


def fingerprint(text: str, words: int = 4) -> int:
    """The fingerprint of one word as a number."""
    return int(fingerprint_words(text, words)[0])


def fingerprints(docs: DataFrame, words: int = 4, k: int = 1) -> DataFrame:
    """``doc_id, node, fp0 ...``: the fingerprint as signed 64-bit numbers, and a number for all of it (``fp0`` itself if it is one)."""
    names = [f"fp{i}" for i in range(k)]
    schema = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in names)])

    def each(batch: pa.RecordBatch) -> dict:
        found = np.array([fingerprint_words(t, words, k) for t in batch.column(1).to_pylist()], np.uint64).reshape(-1, k).view(np.int64)
        return {"doc_id": batch.column(0)} | {x: np.ascontiguousarray(found[:, i]) for i, x in enumerate(names)}

    rows = texts(docs).mapInArrow(arrow_map(schema, each, 256), ", ".join(f"{x} long" for x in ("doc_id", *names)))
    return rows.select("doc_id", (F.col("fp0") if k == 1 else F.xxhash64(*names)).alias("node"), *names)


def variants(distinct: DataFrame, word: str) -> DataFrame:
    """One row per bit of a word: ``key`` is the segment of that bit with the bit as a wildcard; all columns of ``distinct`` go along."""
    keys = []
    for first, last in SEGMENTS:
        mask = (1 << (last - first)) - 1
        segment = F.shiftrightunsigned(word, first).bitwiseAND(F.lit(mask))
        keys += [segment.bitwiseAND(F.lit(mask & ~(1 << bit))) + F.lit((first + bit) << 22) for bit in range(last - first)]
    return distinct.select(F.explode(F.array(*keys)).alias("key"), *distinct.columns)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node reachable) that connect what the links a-b connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the links a-b make a lightest spanning forest: at each step every tree takes its lightest link to another."""
    order = np.argsort(weight, kind="stable")
    nodes, at = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root, left, taken = np.arange(len(nodes)), np.arange(len(a)), [np.zeros(0, np.int64)]
    while len(left := left[root[x[left]] != root[y[left]]]):
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, root[x[left]], left)
        np.minimum.at(best, root[y[left]], left)
        new = np.unique(best[best < len(a)])
        taken.append(new)
        low, high = np.minimum(root[x[new]], root[y[new]]), np.maximum(root[x[new]], root[y[new]])
        tops, tree = forest(high, low)
        move = np.arange(len(nodes))
        move[tops] = tree
        root = move[root]
    return order[np.concatenate(taken)]


def run_pairs(key: np.ndarray, node: np.ndarray, fp: np.ndarray, most: int, tree: np.ndarray, held: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`run_links`, but every link is a pair that was compared, so it can be verified: of each run a lightest spanning forest."""
    found, size = [], 0

    def reduced() -> np.ndarray:
        i, j, bits = np.concatenate([*found, np.zeros((3, 0), np.int64)], axis=1)
        return np.stack([i, j, bits])[:, spanning(i, j, bits)]  # rows, not nodes, so runs stay apart

    at, step = np.arange(len(key)), 0
    while len(at):
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at + step] == key[at]]
        apart = at[tree[at] != tree[at + step]]
        bits = np.bitwise_count(fp[apart] ^ fp[apart + step]).sum(axis=1, dtype=np.int64)
        near = bits <= most
        found.append(np.stack([apart[near], apart[near] + step, bits[near]]))
        size += int(near.sum())
        if size > held:
            found = [reduced()]
            size = 0
    i, j, _ = reduced()
    return node[i], node[j]


def run_links(key: np.ndarray, node: np.ndarray, fp: np.ndarray, most: int, tree: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of nodes within runs of equal keys whose fingerprints (rows of words) differ in at most ``most`` bits; with ``tree``, between trees only."""
    found_a, found_b = [], []
    at = np.arange(len(key))
    step = 0
    while len(at):
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at + step] == key[at]]
        apart = at if tree is None else at[tree[at] != tree[at + step]]
        near = apart[np.bitwise_count(fp[apart] ^ fp[apart + step]).sum(axis=1) <= most]
        if len(near):
            found_a.append(node[near]), found_b.append(node[near + step])
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def _link_sorted(most: int, of_run=run_links):
    """Rows (key, node, tree, words) sorted by key to links: a run that goes on in the next batch is carried over to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None

        def links(part: np.ndarray) -> pa.RecordBatch:
            a, b = of_run(part[:, 0], part[:, 1], part[:, 3:].view(np.uint64), most, part[:, 2])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=LINKS)

        for batch in batches:
            new = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            rows = new if rows is None else np.concatenate([rows, new])
            done = int(np.searchsorted(rows[:, 0], rows[-1, 0])) if len(rows) else 0
            if done >= 1 << 16:
                yield links(rows[:done])
                rows = rows[done:]
        if rows is not None and len(rows):
            yield links(rows)

    return run


def word_links(distinct: DataFrame, word: str, run, block: int = 2048, broadcast_rows: int = 100_000) -> DataFrame:
    """``a, b``: what ``run`` finds in the sorted runs of equal variants of one word of ``distinct(node, tree, fp0 ...)``."""
    words = distinct.columns[2:]
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = variants(distinct, word)
    hot = staged(index.groupBy("key").count().where(F.col("count") > block), "hot-variants")
    n_hot = hot.count()
    small = F.broadcast(hot) if n_hot <= broadcast_rows else hot
    usual = index.join(small, "key", "left_anti") if n_hot else index
    links = usual.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
    if n_hot:
        # Block i of a hot variant meets every block: it goes to the pairs (i, j), each a key of its own.
        many = index.join(small, "key").withColumn("blocks", F.ceil(F.col("count") / block).cast("long"))
        own = F.pmod(F.xxhash64("node"), F.col("blocks"))
        dealt = many.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        paired = dealt.select(pair.alias("key"), "node", "tree", *words).repartition(n, "key").sortWithinPartitions("key")
        links = links.unionByName(paired.mapInArrow(run, "a long, b long"))
    return links


def near_links(distinct: DataFrame, most: int = 4, block: int = 2048, broadcast_rows: int = 100_000) -> DataFrame:
    """``a, b``: links of ``distinct(node, fp0 ...)`` that connect its pairs of at most ``most`` differing bits.

    With one word, all pairs of up to five bits are found. With several words every word is an index
    of its own, gone through one after the other, and a pair is found that has in any word a segment
    with at most one differing bit.
    """
    words = distinct.columns[1:]
    distinct = distinct.select("node", F.col("node").alias("tree"), *words)
    out = None
    for i, word in enumerate(words):
        links = word_links(distinct, word, _link_sorted(most), block, broadcast_rows)
        if i == 0 and len(words) > 1:
            roots = staged(components(links).select(F.col("node").alias("a"), F.col("root").alias("b")), "trees")
            links = roots.where("a <> b")
            tree = F.coalesce("b", "node").alias("tree")
            distinct = staged(distinct.join(roots, distinct.node == roots.a, "left").select("node", tree, *words), "nodes-of-trees")
        elif len(words) > 1:
            links = staged(links, f"links-{i}")
        out = links if out is None else out.unionByName(links)
    return out


def simhash_components(docs: DataFrame, words: int = 4, most: int = 4, k: int = 1) -> DataFrame:
    """``doc_id, fp, fingerprint, component_id`` for every row of ``docs``.

    Fingerprints of ``k`` words link at ``most`` or fewer differing bits (at most 5 if ``k`` is 1);
    the component's id is its smallest doc_id; ``fingerprint`` is the first word. A null or empty
    text has fingerprint zero and links like any other. Null keys have no part in the minimum.
    Repeated rows are each returned; an empty table gives none; other columns are not read.
    """
    if k == 1 and most > 5:
        raise ValueError("three segments find pairs of at most five differing bits")
    prints = staged(fingerprints(docs, words, k), "fingerprints")
    names = [f"fp{i}" for i in range(k)]
    distinct = staged(prints.groupBy("node", *names).agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(near_links(distinct.select("node", *names), most)).withColumnRenamed("node", "at")
    rooted = distinct.join(roots, distinct.node == roots["at"], "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    rooted = staged(rooted, "fingerprints-of-trees")
    least = staged(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")  # apart from the join, which may then be split
    of_print = staged(rooted.join(least, "root").select("node", "component_id").distinct(), "components-of-fingerprints")
    return prints.join(of_print, "node").select("doc_id", F.col("fp0").alias("fp"), F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str, words: int) -> frozenset[bytes]:
    """The distinct shingles; texts without words are alike, so they have one empty shingle."""
    return frozenset(shingles_of(text, words)) or frozenset([b""])


def _digests(shingles: frozenset[bytes]) -> bytes:
    return b"".join(map(partial(xxhash.xxh3_128_digest, seed=42), shingles))


def _keys(digests: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(digests, "<i8")[::2])


def common_shingles(rows: DataFrame, words: int, sample: int = 20_000, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of shingles that three or more of about ``sample`` rows share, and their counts; the ``most`` frequent ones."""
    schema = pa.schema([("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            keys = [_keys(_digests(shingle_set(t, words))) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]))], schema=schema)

    share = max(1, rows.count() // sample)
    some = rows.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).mapInArrow(run, "key long")
    found = some.groupBy("key").count().where("count >= 3").orderBy(F.desc("count"), "key").limit(most).collect()
    keys = np.array([x["key"] for x in found], np.int64)
    order = np.argsort(keys)
    return keys[order], np.array([x["count"] for x in found], np.int64)[order]


def shingle_sets(rows: DataFrame, words: int, least: float) -> DataFrame:
    """``node, n, fp0, fp1, keys``: the size of each set of shingles, its SimHash of two words, and the shingles of its prefix.

    Shingles have one order in all sets, common ones last. Two sets of a Jaccard similarity of ``least``
    or more share at least ``ceil(least * n)`` of either's ``n`` shingles, so each one's first
    ``n - ceil(least * n) + 1`` have a shingle in common. The order needs no exact counts.
    """
    common, counts = common_shingles(rows, words)
    schema = pa.schema([*((x, pa.int64()) for x in ("node", "n", "fp0", "fp1")), ("keys", pa.list_(pa.int64()))])

    def each(part: pa.RecordBatch) -> dict:
        sizes, prints, prefix = [], [], []
        for text in part.column(1).to_pylist():
            shingles = shingle_set(text, words)
            digests = _digests(shingles)
            keys = _keys(digests)
            if len(common):
                at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
                keys = keys[np.argsort(np.where(common[at] == keys, counts[at], 0), kind="stable")]
            sizes.append(len(shingles)), prints.append(_ones(digests, len(shingles), 128).view(np.int64))
            prefix.append(keys[: len(keys) - math.ceil(least * len(keys) - 1e-9) + 1])
        fp = np.array(prints, np.int64).reshape(-1, 2)
        return {"node": part.column(0), "n": sizes, "fp0": np.ascontiguousarray(fp[:, 0]), "fp1": np.ascontiguousarray(fp[:, 1]), "keys": prefix}

    return rows.select("node", "text").mapInArrow(arrow_map(schema, each, 256), "node long, n long, fp0 long, fp1 long, keys array<long>")


def _whole_runs(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[np.ndarray]:
    """Rows sorted by their first column as arrays that hold whole runs of it."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns if c.type == pa.int64()], axis=1)
        if batch.schema.field(batch.num_columns - 1).type == pa.binary():
            maps = np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist()), np.int64)
            new = np.concatenate([new, maps.reshape(len(new), -1)], axis=1)
        cut = int(np.searchsorted(new[:, 0], new[-1, 0]))
        if held and (cut or held[-1][-1, 0] != new[0, 0]) and sum(map(len, held)) + cut >= rows:
            yield np.concatenate([*held, new[:cut]])
            held = [new[cut:]]
        else:
            held.append(new)
    if held:
        yield np.concatenate(held)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i])) for i in range(2)], schema=LINKS)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose key another row has too."""
    for rows in _whole_runs(batches):
        same = rows[1:, 0] == rows[:-1, 0]
        kept = rows[np.append(same, False) | np.append(False, same)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(kept[:, i])) for i in range(2)], names=["key", "node"])


def bitmaps(rows: DataFrame, words: int, bits: int = 4096) -> DataFrame:
    """``node, n, marked, bitmap``: the number of a set's shingles, of the bits they mark, and the bits."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("marked", pa.int64()), ("bitmap", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            nodes, sizes, marked, maps = part.column(0).to_pylist(), [], [], []
            for text in part.column(1).to_pylist():
                shingles = shingle_set(text, words)
                at = np.unique(np.frombuffer(_digests(shingles), "<u8")[::2] % np.uint64(bits)).astype(np.int64)
                flags = np.zeros(bits, np.uint8)
                flags[at] = 1
                sizes.append(len(shingles)), marked.append(len(at)), maps.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((nodes, sizes, marked, maps), schema, strict=True)], schema=schema)

    return rows.select("node", "text").mapInArrow(run, "node long, n long, marked long, bitmap binary")


def _between_trees(least: float):
    """All pairs of rows (key, node, n, marked, tree, bitmap) of a run that stand in different trees and can reach the similarity ``least``.

    Common shingles mark common bits, and at most ``n - marked`` of a set's shingles share a bit with another of
    them, so two sets have at most (common bits + the lesser of both ``n - marked``) shingles in common: no
    pair that reaches ``least`` is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_runs(batches, 1 << 13):
            size, spare, maps = rows[:, 2], rows[:, 2] - rows[:, 3], rows[:, 5:].view(np.uint64)
            at, step = np.arange(len(rows)), 0
            while len(at):
                step += 1
                at = at[at + step < len(rows)]
                at = at[rows[at + step, 0] == rows[at, 0]]
                apart = at[rows[at, 4] != rows[at + step, 4]]
                n, m = size[apart], size[apart + step]
                apart, total = apart[close := np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9], (n + m)[close]
                common = np.bitwise_count(maps[apart] & maps[apart + step]).sum(axis=1, dtype=np.int64)
                most = np.minimum(common + np.minimum(spare[apart], spare[apart + step]), total)
                near = apart[most * (1 + least) >= least * total - 1e-6]
                if len(near):
                    yield _pairs(rows[near, 1], rows[near + step, 1])

    return run


def jaccard_links(pairs: DataFrame, rows: DataFrame, words: int, least: float, broadcast_rows: int = 500_000) -> DataFrame:
    """The pairs (a, b) of ``rows(node, text)`` whose sets of shingles have a Jaccard similarity of ``least`` or more."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    nodes = staged(nodes, "pair-nodes")
    body = staged(rows.join(F.broadcast(nodes) if nodes.count() <= broadcast_rows else nodes, "node"), "pair-texts")
    both = pairs.join(body.select(F.col("node").alias("a"), F.col("text").alias("of_a")), "a").join(body.select(F.col("node").alias("b"), F.col("text").alias("of_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(256)(partial(shingle_set, words=words))
        for part in slices(batches, 256):
            ok = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                x, y = of(x), of(y)
                common = len(x & y)
                ok.append(common / (len(x) + len(y) - common) >= least)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in part.columns[:2]], schema=LINKS)

    links = staged(both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long"), "jaccard-links")
    release(body, nodes)
    return links


def jaccard_components(rows: DataFrame, words: int = 5, least: float = 0.8, most: int = 28) -> DataFrame:
    """``node, root`` of the nodes of ``rows(node, text)`` that have a row of similarity ``least`` or more.

    First come the pairs of SimHash: distinct fingerprints of two words enter the index of each word by their variants,
    equal variants are joined, and of each run the lightest spanning forest of pairs with at most ``most`` of 128
    differing bits is verified on the shingles; the second word only joins trees that the first left apart. ``most``
    sets how much is found here, not what is linked: after it, all pairs between trees that share a shingle of
    their prefixes are verified too, but for those that an exact bound rules out.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = staged(shingle_sets(rows, words, least), "shingle-sets")
    distinct = staged(sets.groupBy("fp0", "fp1").agg(F.min("node").alias("node")).select("node", "fp0", "fp1"), "distinct-fingerprints")
    same = sets.join(distinct.withColumnRenamed("node", "first"), ["fp0", "fp1"]).where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    links = done = trees = None

    def tree_of(table: DataFrame, *columns: str) -> DataFrame:
        if trees is None:
            return table.select("node", F.col("node").alias("tree"), *columns)
        at = trees.select(F.col("node").alias("at"), "root")
        return table.join(at, table.node == F.col("at"), "left").select("node", F.coalesce("root", "node").alias("tree"), *columns)

    for step in ("fp0", "fp1", "prefixes"):
        if step != "prefixes":
            found = word_links(tree_of(distinct, "fp0", "fp1"), step, _link_sorted(most, run_pairs))
            found = found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            found = found.unionByName(same) if step == "fp0" else found
        else:
            index = sets.select(F.explode("keys").alias("key"), "node").repartition(n, "key").sortWithinPartitions("key")
            shared = staged(index.mapInArrow(_shared, "key long, node long"), "shared-prefixes")
            of_trees = staged(tree_of(shared, "key"), "prefixes-of-trees")
            several = of_trees.groupBy("key").agg(F.min("tree").alias("low"), F.max("tree").alias("high")).where("low < high").select("key")
            left = staged(of_trees.join(several, "key", "left_semi").select("key", "node", "tree"), "keys-of-several-trees")
            some = left.select(F.col("node").alias("at")).distinct()
            maps = staged(bitmaps(rows.join(some, rows.node == F.col("at"), "left_semi"), words), "bitmaps")
            wide = left.join(maps, "node").select("key", "node", "n", "marked", "tree", "bitmap")
            found = wide.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(_between_trees(least), "a long, b long")
            release(shared, of_trees)
        pairs = found.distinct() if done is None else found.distinct().join(done, ["a", "b"], "left_anti")
        pairs = staged(pairs, "candidate-pairs")
        if pairs.isEmpty():
            continue
        new = jaccard_links(pairs, rows, words, least)
        done = pairs if done is None else staged(done.unionByName(pairs), "verified-pairs")
        links = new if links is None else staged(links.unionByName(new), "links-so-far")
        trees = staged(components(links), "trees")
    release(sets, distinct)
    return rows.select("node", F.col("node").alias("root")).limit(0) if trees is None else trees


def drop_near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component of near copies, with all columns as they are.

    Rows are linked where the sets of their word shingles have a Jaccard similarity of ``least`` or more;
    null and empty texts are alike. The row that stays is that with the smallest key, null keys last, and
    of equal keys the first by file and row. Rows are told apart by file and row, so a key that is null or
    repeated stands for no other row.
    """
    docs = from_files(docs)
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    files = staged(numbered(docs.select(file.alias("__path")).distinct(), "__path"), "file-numbers").withColumnRenamed("number", "__number")
    rows = docs.select(file.alias("__file"), row.alias("__row"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    known = rows.join(small(files), F.col("__file") == F.col("__path")).withColumn("node", F.shiftleft("__number", 40) + F.col("__row"))
    found = jaccard_components(known.select("node", "text"), words, least)
    found = found.withColumnRenamed("node", "__node")
    ranked = known.select("node", "__file", "__row", "id").join(found, F.col("node") == F.col("__node"))
    ranked = staged(ranked.select("root", "node", "__file", "__row", F.struct(F.col("id").isNull().alias("none"), "id", "node").alias("rank")), "component-rows")
    kept = ranked.groupBy("root").agg(F.min("rank").alias("first"))
    of, at = spare(docs, "__file", "__row")
    gone = ranked.join(kept.select(F.col("first.node").alias("node")), "node", "left_anti").select(F.col("__file").alias(of), F.col("__row").alias(at))
    return without(docs.select("*", file.alias(of), row.alias(at)), gone, [of, at]).drop(of, at)
