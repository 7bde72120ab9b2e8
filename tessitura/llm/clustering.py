"""Lloyd's centroid clustering by two trees: a cover tree over each shard of vectors, one over the centroids per round.

Vectors are integers, so distances, sums and ties are exact. The trees of the vectors are built once and lie as a
table of shards in the shared folder; every round walks them against the tree of that round's centroids and prunes
pairs of nodes by bounds on distances. Centroids are few and of known size: they travel with the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged

#: Components are held within this size, so that a squared distance of 64 of them fits a long.
LARGEST = 1 << 27
#: Up to this size of components products and their sums are exact in doubles.
EXACT = 1 << 20
SLACK = 1e-6


def held(points: np.ndarray) -> np.ndarray:
    """Integer points as doubles if sums of their products are exact in doubles, else as int64."""
    return points.astype(np.float64 if np.abs(points).max(initial=0) <= EXACT else np.int64)


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances, exact, of every point to every other one: of :func:`held` points."""
    if points.dtype == others.dtype == np.float64:
        out = points @ (-2 * others.T)
        out += np.einsum("ij,ij->i", points, points)[:, None]
        out += np.einsum("ij,ij->i", others, others)[None, :]
        return out
    a, b = points.astype(np.int64), others.astype(np.int64)
    out = np.empty((len(a), len(b)), np.int64)
    for at, other in enumerate(b):
        gap = a - other
        out[:, at] = (gap * gap).sum(1)
    return out


def _balls(points: np.ndarray, own: np.ndarray, most: float, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """``own`` as balls around pivots, each the first point that no ball before it holds, and the balls' sizes.

    A ball has the points within a squared distance of ``most`` of its pivot, which comes first.
    """
    found, sizes = [], []
    while len(own):
        near = distances(points[own], points[own[:block]]) <= most
        pivots: list[int] = []
        free = np.ones(near.shape[1], bool)
        for j in range(near.shape[1]):
            if free[j]:
                near[j, j] = True
                pivots.append(j)
                free &= ~near[: len(free), j]
        near = near[:, pivots]
        inside = near.any(1)
        ball = near.argmax(1)[inside]
        found.append(own[inside][np.argsort(ball, kind="stable")])
        sizes.append(np.bincount(ball, minlength=len(pivots)))
        own = own[~inside]
    return np.concatenate(found), np.concatenate(sizes)


class CoverTree:
    """Nested balls over ``points``: each node is a run of ``order`` that begins with its pivot.

    A node's children cover it with balls of half its radius, whose pivots are further apart than that;
    the first child keeps the node's pivot. Nodes of at most ``leaf`` points, or of equal points, are leaves.
    Children of a node lie side by side: ``first`` and ``kids``.
    """

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.points = points
        order = np.arange(len(points))
        runs, radii, first, kids = [(0, len(points))] if len(points) else [], [], [], []
        at = 0
        while at < len(runs):
            lo, hi = runs[at]
            own = order[lo:hi]
            radius = float(np.sqrt(distances(points[own], points[own[:1]]).max())) if hi - lo > 1 else 0.0
            first.append(len(runs))
            if hi - lo > leaf and radius > 0:
                order[lo:hi], sizes = _balls(points, own, radius * radius / 4)
                ends = lo + np.cumsum(sizes)
                runs += zip((ends - sizes).tolist(), ends.tolist(), strict=True)
            kids.append(len(runs) - first[-1])
            radii.append(radius)
            at += 1
        self.order = order
        self.lo = np.array([r[0] for r in runs], np.int64)
        self.hi = np.array([r[1] for r in runs], np.int64)
        self.radius = np.array(radii)
        self.first, self.kids = np.array(first, np.int64), np.array(kids, np.int64)

    def children(self) -> np.ndarray:
        """A row per node, true at its children, or at itself if it has none."""
        out = np.zeros((len(self.lo), len(self.lo)), np.float32)
        for node, (first, kids) in enumerate(zip(self.first, self.kids, strict=True)):
            out[node, first : first + kids] = 1
            out[node, node] = kids == 0
        return out

    def pivots(self, nodes: np.ndarray) -> np.ndarray:
        return self.points[self.order[self.lo[nodes]]]


def nearest(tree: CoverTree, centroids: CoverTree) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point (ties: the smaller number) and its squared distance.

    Level by level, each node of ``tree`` holds the nodes of ``centroids`` that may have the nearest centroid of
    one of its points. A pair goes when its closest points are further apart than the farthest a point of the
    node can be from some centroid. What is left at a leaf is compared point by point.
    """
    count = len(tree.points)
    best, gap = np.zeros(count, np.int64), np.zeros(count, np.int64)
    children, inner_q = centroids.children(), centroids.kids > 0
    nodes = np.zeros(min(count, 1), np.int64)
    open_ = np.zeros((len(nodes), len(centroids.lo)), bool)
    open_[:, 0] = True
    while len(nodes):
        used = np.flatnonzero(open_.any(0))
        far = np.where(open_[:, used], np.sqrt(distances(tree.pivots(nodes), centroids.pivots(used))), np.inf)
        radius = tree.radius[nodes]
        most = (far.min(1) + radius) * (1 + SLACK) + SLACK
        keep = np.zeros_like(open_)
        keep[:, used] = far - radius[:, None] - centroids.radius[used] <= most[:, None]
        leaf = tree.kids[nodes] == 0
        split = keep & inner_q & (leaf[:, None] | (centroids.radius >= radius[:, None]))
        open_ = (keep & ~split) | (split.astype(np.float32) @ children > 0)
        ready = leaf & ~(open_ & inner_q).any(1)
        for mask, ended in _alike(open_[ready], nodes[ready]):
            numbers = np.sort(np.concatenate([centroids.order[centroids.lo[q] : centroids.hi[q]] for q in np.flatnonzero(mask)]))
            own = tree.order[_ranges(tree.lo[ended], tree.hi[ended] - tree.lo[ended])]
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                d = distances(tree.points[part], centroids.points[numbers])
                least = d.argmin(1)
                best[part], gap[part] = numbers[least], d[np.arange(len(part)), least]
        wait, inner = leaf & ~ready, ~leaf
        kids = tree.kids[nodes[inner]]
        nodes, open_ = np.concatenate([_ranges(tree.first[nodes[inner]], kids), nodes[wait]]), np.concatenate([np.repeat(open_[inner], kids, axis=0), open_[wait]])
    return best, gap


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the runs that begin at ``first``."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _alike(masks: np.ndarray, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes by equal masks."""
    bits = np.ascontiguousarray(np.packbits(masks, axis=1))
    keys = bits.view(f"V{bits.shape[1]}").ravel() if len(bits) else bits[:0, 0]
    _, at, group = np.unique(keys, return_index=True, return_inverse=True)
    by = np.argsort(group, kind="stable")
    for n, some in enumerate(np.split(nodes[by], np.cumsum(np.bincount(group))[:-1]) if len(nodes) else []):
        yield masks[at[n]], some


SHARD = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.binary()), ("width", pa.int32()), ("order", pa.list_(pa.int32())), ("runs", pa.list_(pa.int32())), ("radius", pa.list_(pa.float64())), ("kids", pa.list_(pa.int32()))])
SHARD_DDL = "ids array<long>, points binary, width int, order array<int>, runs array<int>, radius array<double>, kids array<int>"


def _narrow(points: np.ndarray) -> np.ndarray:
    top = np.abs(points).max(initial=0)
    return points.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def _planted(size: int, components: int, leaf: int):
    """For ``mapInArrow``: vectors (vec_id, v) to shards of up to ``size`` vectors with their cover trees."""

    def shard(ids: list, blocks: list[np.ndarray]) -> pa.RecordBatch:
        points = np.concatenate(blocks)
        tree, narrow = CoverTree(held(points), leaf), _narrow(points)
        runs = np.stack([tree.lo, tree.hi], 1).ravel()
        columns = [[ids], [narrow.tobytes()], [narrow.itemsize], [tree.order], [runs], [tree.radius], [tree.kids]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SHARD.types, strict=True)], schema=SHARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        blocks: list[np.ndarray] = []
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids += part.column(0).to_pylist()
                blocks.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, components))
                while len(ids) >= size:
                    points = np.concatenate(blocks)
                    yield shard(ids[:size], [points[:size]])
                    ids, blocks = ids[size:], [points[size:]]
        if ids:
            yield shard(ids, blocks)

    return run


def _shards(batches: Iterator[pa.RecordBatch], components: int) -> Iterator[tuple[list, CoverTree]]:
    for batch in batches:
        for row in batch.to_pylist():
            tree = CoverTree.__new__(CoverTree)
            tree.points = np.frombuffer(row["points"], f"i{row['width']}").reshape(-1, components)
            tree.points = held(tree.points)
            tree.order = np.array(row["order"], np.int64)
            runs = np.array(row["runs"], np.int64).reshape(-1, 2)
            tree.lo, tree.hi, tree.radius = runs[:, 0], runs[:, 1], np.array(row["radius"])
            tree.kids = np.array(row["kids"], np.int64)
            tree.first = 1 + np.cumsum(tree.kids) - tree.kids
            yield row["ids"], tree


def _sums(centroids: np.ndarray):
    """For ``mapInArrow``: shards to one row per centroid and task, the count and the sums of its vectors."""
    count, components = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = CoverTree(held(centroids), 1)
        counts, sums = np.zeros(count, np.int64), np.zeros((count, components), np.int64)
        for _, tree in _shards(batches, components):
            best, _ = nearest(tree, over)
            counts += np.bincount(best, minlength=count)
            for c in np.unique(best):
                sums[c] += tree.points[best == c].astype(np.int64).sum(0)
        had = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(had, pa.int32()), pa.array(counts[had]), pa.array(list(sums[had]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray):
    """For ``mapInArrow``: shards to (vec_id, cluster, distance) of their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = CoverTree(held(centroids), 1)
        for ids, tree in _shards(batches, centroids.shape[1]):
            best, gap = nearest(tree, over)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(best, pa.int32()), pa.array(gap)], names=["vec_id", "cluster", "distance"])

    return run


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, components: int = 64, scale: int = 256, shard: int = 2048, leaf: int = 16) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for each usable vector (vec_id, embedding).

    Usable are vectors of exactly ``components`` components, none of them null, NaN or infinite; others give no row.
    A component becomes ``floor(scale * x)``, held within 2^27 either way. Centroids start as the ``k`` vectors with
    the smallest SHA-256 of ``seed:vec_id`` (of equal ones, as under one vec_id or none, the smaller vector first), are
    moved ``rounds`` times to the floor of the mean of their vectors, and keep their place while they have none.
    Of equally near centroids the smaller number counts. Repeated rows are vectors of their own; with fewer than
    ``k`` vectors there are as many centroids; an empty table gives no rows; other columns are not looked at.
    """
    x = F.transform("embedding", lambda e: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.lit(float(scale)) * e.cast("double")))).cast("long"))
    usable = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != float("inf")))
    kept = vectors.where((F.size("embedding") == components) & usable).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    start = kept.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = np.array([r.v for r in start], np.int64).reshape(-1, components)
    if not len(start):
        return kept.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    trees = staged(kept.mapInArrow(_planted(shard, components, leaf), SHARD_DDL), "cover-trees")
    for _ in range(rounds):
        parts = trees.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
        exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
        moved = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(exact("n").alias("n"), exact("x").alias("x")).collect()
        centroids = centroids.copy()
        for r in moved:  # one row per centroid and component
            centroids[r.cluster, r.at] = int(Decimal(r.x)) // int(Decimal(r.n))
    found = staged(trees.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "assigned")
    release(trees)
    inertia = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = [(c, total, sum(inertia.values()), digest[c]) for c, total in inertia.items()]
    per_cluster = found.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clustering_sql(k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """DuckDB SQL for :func:`clustered`: every vector against every centroid."""
    nearest_of = lambda n: f"""a{n} AS MATERIALIZED (SELECT rid, vec_id, v, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM
          (SELECT rid, vec_id, v, c, CAST(list_sum(list_transform(list_zip(v, u), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{n}) GROUP BY rid, vec_id, v)"""  # noqa: E731
    steps = ""
    for n in range(rounds):
        steps += f""", {nearest_of(n)},
        m{n} AS (SELECT c, pos, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS pos FROM a{n}) GROUP BY ALL),
        g{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS u FROM m{n} GROUP BY c),
        c{n + 1} AS MATERIALIZED (SELECT c, coalesce(g{n}.u, c{n}.u) AS u FROM c{n} LEFT JOIN g{n} USING (c))"""
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        h AS (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c FROM v),
        c0 AS MATERIALIZED (SELECT c, v AS u FROM h WHERE c < {k}){steps}, {nearest_of(rounds)}
        SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
          sha256(array_to_string(list_transform(u, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"""
