"""Recommender: candidates, features, score, ranking, greedy diversity."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.expr import base_id, clamp, noise
from tessitura.operators.library import first_of
from tessitura.operators.listening import last_heard, last_track, skip_counts

MAX_CANDIDATES = 180


def sample_ids(ids: DataFrame, seed: int, n: int = 60) -> DataFrame:
    """Up to ``n`` ids per account, drawn by a hash that the seed fixes."""
    order = Window.partitionBy("account").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id"))), "id")
    return ids.select("account", "id").distinct().withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= n)


def candidates(seeds: DataFrame, liked: DataFrame, tracks: DataFrame, seed: int, per_artist: int = 20, per_album: int = 40) -> DataFrame:
    """``account, pos, id, origin, title, artists, album_id, available`` from three sources.

    Up to 60 of the seeds and likes; of their rows the first two artists' top tracks (``per_artist``
    each) and the first album's tracks (``per_album``). ``liked`` overrides the source's name.
    """
    start = sample_ids(seeds.select("account", "id").union(liked.select("account", "id")), seed)
    known = tracks.select("id", "title", "artists", "album_id", "available")
    seed_rows = start.join(known, "id").select("account", F.lit(0).alias("source"), F.col("draw").alias("at"), "id", "title", "artists", "album_id", "available", F.lit("seed").alias("from"))
    artist_of = seed_rows.select("account", "at", F.posexplode("artists").alias("k", "artist"))
    first_artist = artist_of.groupBy("account", F.col("artist.id").alias("artist_id")).agg(F.min(F.struct("at", "k")).alias("first"))
    by_first = Window.partitionBy("account").orderBy("first", "artist_id")
    two = first_artist.withColumn("n", F.row_number().over(by_first)).where("n <= 2")
    album_of = seed_rows.where("album_id <> ''").groupBy("account", "album_id").agg(F.min("at").alias("first"))
    one = first_of(album_of, ["account"], ["first", "album_id"]).select("account", "album_id")
    lead = known.select("*", F.explode("artists.id").alias("artist_id"), F.length("id").alias("len"))
    top_order = Window.partitionBy("artist_id").orderBy("len", "id")
    top = lead.withColumn("at", F.row_number().over(top_order)).where(F.col("at") <= per_artist).drop("len")
    album_order = Window.partitionBy("album_id").orderBy(F.length("id"), "id")
    on_album = known.withColumn("at", F.row_number().over(album_order)).where(F.col("at") <= per_album)
    columns = ["account", "source", "at", "id", "title", "artists", "album_id", "available", "from"]
    of_artist = two.join(top, "artist_id").select("account", F.col("n").alias("source"), "at", "id", "title", "artists", "album_id", "available", F.lit("artist").alias("from"))
    of_album = one.join(on_album, "album_id").select("account", F.lit(3).alias("source"), "at", "id", "title", "artists", "album_id", "available", F.lit("album").alias("from"))
    rows = seed_rows.select(*columns).unionByName(of_artist.select(*columns)).unionByName(of_album.select(*columns))
    order = Window.partitionBy("account").orderBy("source", "at")
    placed = rows.withColumn("pos", F.row_number().over(order) - 1)
    mine = liked.select("account", "id", F.lit(True).alias("liked")).distinct()
    return placed.join(mine, ["account", "id"], "left").select("account", "pos", "id", F.when(F.col("liked"), "liked").otherwise(F.col("from")).alias("origin"), "title", "artists", "album_id", "available")


def features(rows: DataFrame, liked: DataFrame, events: DataFrame, rated: DataFrame, now: str, most: int = MAX_CANDIDATES) -> DataFrame:
    """Eligible candidates, one row per base id, with all that the score needs.

    Only the first ``most`` rows of an account are eligible, if they are available, not vetoed (-2)
    and not the track heard last; then the first of a base id stays. The familiar artists come from
    all rows whose whole id is liked or that are seeds.
    """
    mine = liked.select("account", F.col("id").alias("liked_id"), F.lit(True).alias("liked")).distinct()
    whole = rows.join(mine.withColumnRenamed("liked_id", "id").withColumnRenamed("liked", "familiar"), ["account", "id"], "left")
    familiar = whole.where(F.col("familiar") | (F.col("origin") == "seed")).select("account", F.explode("artists.id").alias("artist")).groupBy("account").agg(F.collect_set("artist").alias("familiar_artists"))
    pool = rows.where((F.col("pos") < most) & F.col("available")).withColumn("base", base_id("id"))
    pool = pool.join(rated.where("value = -2").select("account", F.col("id").alias("base")), ["account", "base"], "left_anti")
    pool = pool.join(last_track(events).select("account", F.col("id").alias("base")), ["account", "base"], "left_anti")
    pool = first_of(pool, ["account", "base"], ["pos"])
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("at")) / F.lit(86_400_000_000.0)
    return (
        pool.join(mine.withColumnRenamed("liked_id", "base"), ["account", "base"], "left")
        .join(rated.where("value <> -2").select("account", F.col("id").alias("base"), "value"), ["account", "base"], "left")
        .join(last_heard(events).select("account", F.col("id").alias("base"), age.alias("age")), ["account", "base"], "left")
        .join(skip_counts(events).select("account", F.col("id").alias("base"), "skips"), ["account", "base"], "left")
        .join(familiar, "account", "left")
        .select(
            "account", F.col("base").alias("id"), "pos", "origin", "title", F.col("artists.id").alias("artists"), F.coalesce("liked", F.lit(False)).alias("liked"),
            F.coalesce("value", F.lit(0)).alias("vote"), F.col("age"), F.coalesce("skips", F.lit(0)).alias("skips"),
            F.coalesce(F.arrays_overlap("artists.id", "familiar_artists"), F.lit(False)).alias("familiar"),
        )
    )


def score(balance: float, seed: int) -> Column:
    """The score of a row of :func:`features`, to nine digits."""
    b = min(max(balance, 0.0), 1.0)
    total = F.when(F.col("liked"), F.lit(2 * (1 - b))).otherwise(F.lit(2 * b)) + 3.0 * F.col("vote") - 0.2 * F.least(F.col("skips"), F.lit(3))
    total = total + F.when(F.col("familiar"), F.lit(0.7)).otherwise(F.lit(0.0))
    heard = 0.5 * F.least(F.col("age") / 30.0, F.lit(1.0)) - 2.0 * F.greatest(F.lit(0.0), 1.0 - F.col("age"))
    total = total + F.coalesce(heard, F.lit(0.0)) + 0.2 * noise(seed, "id")
    return F.round(total, 9)


def reason() -> Column:
    return (
        F.when(F.col("liked") & (F.coalesce(F.col("age"), F.lit(-1.0)) >= 7), "LIKED_STALE").when(F.col("liked"), "LIKED")
        .when(F.col("origin") == "artist", "KNOWN_ARTIST").when(F.col("origin") == "album", "SEED_ALBUM").otherwise("SEED_TRACK")
    )


def scored(rows: DataFrame, balance: float, seed: int) -> DataFrame:
    return rows.withColumn("score", score(balance, seed)).withColumn("reason", reason())


def ranked(rows: DataFrame) -> DataFrame:
    """Rank by score from the top, then by id as text."""
    order = Window.partitionBy("account").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order))


PICKS_DDL = "account long, pick int, id string, score double, reason string"


def pick_diverse(artists: list[list[str] | None], limit: int, per_artist: int) -> list[int]:
    """Places in a ranked pool that greedy diversity takes, in the order it takes them.

    Rows of one set of artists queue behind each other, and a heap holds the first of each queue. A set with an
    artist without room leaves for good; sets that meet the pick before are put back after the next one.
    """
    queues: dict[frozenset, deque] = {}
    for place, names in enumerate(artists):
        queues.setdefault(frozenset(names or ()), deque()).append(place)
    heads = [(queue[0], names) for names, queue in queues.items()]
    heapify(heads)
    room: dict[str, int] = {}
    picks: list[int] = []
    before: frozenset = frozenset()
    while len(picks) < limit:
        put_back, taken = [], None
        while heads and taken is None:
            head = heappop(heads)
            if not all(room.get(a, per_artist) for a in head[1]):
                continue
            if head[1].isdisjoint(before):
                taken = head
            else:
                put_back.append(head)
        for head in put_back:
            heappush(heads, head)
        if taken is None:
            return picks
        place, before = taken
        picks.append(place)
        room |= {a: room.get(a, per_artist) - 1 for a in before}
        queues[before].popleft()
        if queues[before]:
            heappush(heads, (queues[before][0], before))
    return picks


def greedy(rows: DataFrame, limit: int = 30, per_artist: int = 3) -> DataFrame:
    """``account, pick, id, score, reason`` by greedy diversity over scored rows, one row per id of an account.

    Again and again the best row is taken that shares no artist with the pick before and whose
    artists all have fewer than ``per_artist`` picks; it ends after ``limit`` picks or when no row
    is left that may be taken. Rows without artists are never in the way. An account's pool has at
    most 180 rows, so a task holds a bounded pool at a time; pools are ranked before they get there.
    """
    item = F.struct((-F.col("score")).alias("order"), "id", "artists", "reason")
    pools = rows.groupBy(F.col("account").cast("long").alias("account")).agg(F.array_sort(F.collect_list(item)).alias("pool"))
    ranked_pools = pools.select("account", *(F.col(f"pool.{c}").alias(c) for c in ("artists", "id", "order", "reason")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for account, artists, ids, order, why in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for n, at in enumerate(pick_diverse(artists, limit, per_artist)):
                    for column, value in zip(out, (account, n + 1, ids[at], -order[at], why[at]), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["account", "pick", "id", "score", "reason"])

    return ranked_pools.mapInArrow(run, PICKS_DDL)
