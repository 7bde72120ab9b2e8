"""Clustering against a plain version, and the trees alone."""

import hashlib
import math

import numpy as np
import pytest

from tessitura.llm.clustering import CoverTree, clustered, distances, held, nearest

DDL = "vec_id long, embedding array<float>, label int, cluster string, distance string, v string"


def plain(rows, k, rounds):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e, *_ in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    digest = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(((digest(i), v) for i, v in kept))[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        found = [min((gap(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, m) in zip(kept, found, strict=True) if m == n]
                if own:
                    centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = {n: sum(d for d, m in found if m == n) for n in range(len(centroids))}
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, found, strict=True)), key=repr)


def vectors(seed, count):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (6, 64))
    return [[float(np.float32(x)) for x in centres[rng.integers(6)] + rng.normal(0, 0.05, 64)] for _ in range(count)]


@pytest.mark.parametrize("shard, leaf", [(2048, 16), (50, 2)])
def test_equals_a_plain_version(spark, shard, leaf):
    rows = [(i, v, 1, "c", "d", "v") for i, v in enumerate(vectors(1, 300))]
    hot = rows[0][1]
    rows += [(1000 + i, hot, 1, "c", "d", "v") for i in range(150)] + [(5, hot, 1, "c", "d", "v")] * 2 + [(None, hot, None, "c", "d", "v"), (None, rows[3][1], None, "c", "d", "v")]
    bad = [None, [], [0.5] * 63, [0.5] * 65, [None] + [0.5] * 63, [float("nan")] + [0.5] * 63, [float("-inf")] + [0.5] * 63]
    rows += [(2000 + i, b, 1, "c", "d", "v") for i, b in enumerate(bad)]
    got = clustered(spark.createDataFrame(rows, DDL).repartition(3), k=12, rounds=3, shard=shard, leaf=leaf).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows, 12, 3)


def test_few_and_no_vectors_and_large_components(spark):
    assert clustered(spark.createDataFrame([], DDL)).collect() == []
    rows = [(1, [3e38] * 64, 1, "", "", ""), (2, [-3e38] * 64, 1, "", "", ""), (3, [0.0] * 64, 1, "", "", "")]
    got = clustered(spark.createDataFrame(rows, DDL)).collect()
    assert len(got) == 3 and all(r.distance == 0 for r in got) and len({r.cluster for r in got}) == 3
    wide = [(i, [1e4 * ((i * 7 + j) % 11) for j in range(64)], 1, "", "", "") for i in range(40)]
    assert sorted((tuple(r) for r in clustered(spark.createDataFrame(wide, DDL), k=5, rounds=2).collect()), key=repr) == plain(wide, 5, 2)


def test_trees_prune_and_stay_exact():
    rng = np.random.default_rng(5)
    centres = rng.integers(-5000, 5000, (12, 8))
    points = held((centres[rng.integers(12, size=3000)] + rng.integers(-40, 40, (3000, 8))).astype(np.int64))
    tree, over = CoverTree(points, 8), CoverTree(held(centres.astype(np.int64)), 1)
    best, gap = nearest(tree, over)
    every = distances(points, held(centres.astype(np.int64)))
    assert (best == every.argmin(1)).all() and (gap == every.min(1)).all()
    inner = np.flatnonzero(tree.kids)
    assert len(inner) > 12 and sorted(tree.order.tolist()) == list(range(3000))
    for node in inner:  # the children cover their node with half the radius, and their pivots are apart
        kids = np.arange(tree.first[node], tree.first[node] + tree.kids[node])
        assert tree.lo[kids[0]] == tree.lo[node] and tree.hi[kids[-1]] == tree.hi[node] and (tree.radius[kids] <= tree.radius[node] / 2 + 1e-9).all()
        apart = distances(tree.pivots(kids), tree.pivots(kids)) + np.eye(len(kids)) * 1e18
        assert (apart > tree.radius[node] ** 2 / 4).all()


def test_ties_go_to_the_smaller_number():
    points = held(np.array([[0, 0], [2, 0], [1, 0]], np.int64))
    over = CoverTree(held(np.array([[2, 0], [0, 0], [2, 0]], np.int64)), 1)
    assert nearest(CoverTree(points, 1), over)[0].tolist() == [1, 0, 0]
