"""Streams whose rows count as they arrive: player events held for their acknowledgement, results of old requests, exact counters.

Of one micro-batch the rows of a key are taken by ``seq``; a key's micro-batches follow each other. State is kept per
bucket of keys (:mod:`tessitura.streaming.buckets`), that of the counters by Spark's own operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.streaming.buckets import Bucketed, bucketed

#: Events of the player as a whole, which belong to no entry.
ALWAYS = ("pause", "volume", "mute")


class Acceptance(Bucketed):
    """Player events of a session (seq, kind, entry, name): what comes after ``load`` and before its ``ack`` is held, the last ``most``.

    The acknowledgement names the entry; events of it are replayed then and passed from then on, others are dropped.
    Events of ``ALWAYS`` pass at once. A session begins waiting.
    """

    columns = ["seq", "kind", "entry", "name"]
    out = ["seq", "entry", "name", "replayed"]

    def __init__(self, most: int = 64) -> None:
        self.most = most

    def fold(self, key, state, rows, now_ms, found):
        own, pending = state or (None, [])
        for seq, kind, entry, name in sorted(rows, key=lambda r: r[:2]):
            if kind == "load":
                own, pending = None, []
            elif kind == "ack":
                own = entry
                found += [(*p, True) for p in pending if p[1] == own and own is not None]
                pending = []
            elif name in ALWAYS:
                found.append((seq, entry, name, False))
            elif own is None:
                pending = [*pending, (seq, entry, name)][-self.most :]
            elif entry == own:
                found.append((seq, entry, name, False))
        return None if own is None and not pending else (own, pending)


def accepted(events: DataFrame, acks: DataFrame, held: int = 64) -> DataFrame:
    """``session, seq, entry, name, replayed`` of two streams: events (session, seq, entry, name) and acknowledgements (session, seq, entry).

    An acknowledgement with a null entry is a new load: the session waits again.
    """
    rows = events.select("session", "seq", F.lit("event").alias("kind"), F.col("entry").cast("string").alias("entry"), "name")
    kind = F.when(F.col("entry").isNull(), "load").otherwise("ack")
    rows = rows.unionByName(acks.select("session", "seq", kind.alias("kind"), F.col("entry").cast("string").alias("entry"), F.lit(None).cast("string").alias("name")))
    found = bucketed(rows, "session", Acceptance(held), "seq long, entry string, name string, replayed boolean")
    return found.withColumn("entry", F.col("entry").cast("long"))


class Latest(Bucketed):
    """Requests and results of a key (seq, kind, version, id): a result counts if no later version was asked for before it came."""

    columns = ["seq", "kind", "version", "id"]
    out = ["seq", "version", "id", "current"]

    def fold(self, key, latest, rows, now_ms, found):
        for seq, kind, version, result in sorted(rows, key=lambda r: (*r[:3], r[3] is None, r[3] or "")):
            if kind == "request":
                latest = version if latest is None else max(latest, version)
            else:
                found.append((seq, version, result, latest is None or version >= latest))
        return latest


def judged_results(results: DataFrame, requests: DataFrame) -> DataFrame:
    """``key, seq, version, id, current`` of two streams: results (key, seq, version, id), and requests (key, seq, version) that make older ones stale.

    Of equal ``seq`` the request comes first. Rows without a version are no requests and no results.
    """
    rows = results.select("key", "seq", F.lit("result").alias("kind"), "version", F.col("id").cast("string").alias("id"))
    rows = rows.unionByName(requests.select("key", "seq", F.lit("request").alias("kind"), "version", F.lit(None).cast("string").alias("id"))).where("version IS NOT NULL")
    return bucketed(rows, "key", Latest(), "seq long, version long, id string, current boolean").withColumn("id", F.col("id").cast("long"))


def batch_counts(batches: DataFrame) -> DataFrame:
    """``station, received, played`` after each micro-batch that changed them, of a stream (station, batch, played).

    A batch is received once and played once: the first row of either kind is found by Spark's deduplication, which
    deals by station and batch, and counted by its aggregation, of which each task sends a row per station.
    """
    kinds = F.array_compact(F.array(F.lit("received"), F.when(F.col("played"), "played")))
    rows = batches.where("batch IS NOT NULL").select("station", F.col("batch").cast("string").alias("batch"), F.explode(kinds).alias("kind"))
    first = rows.dropDuplicates(["station", "batch", "kind"])
    return first.groupBy("station").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("received", "played")))
