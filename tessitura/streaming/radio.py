"""Radio as a stream: bounded deduplication of batches, feedback once, stale results, sessions.

State is kept per key by ``transformWithStateInPandas`` (RocksDB provider). Rows of a micro-batch
are handled in the order of their time and id, so results don't depend on how files were grouped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessitura.sources import versions

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which several kinds of state need; the session's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class BoundedDedup(StatefulProcessor):
    """Rows (seq, action, batch, track, available): ``offer`` queues a track unless it is queued, or among the last played; ``play`` plays it.

    Yields a row per accepted offer and per play, with how many are queued after it and whether the
    queue is low. A track may return when ``memory`` others have been played since.
    """

    def __init__(self, memory: int = 100, low_water: int = 2) -> None:
        self.memory, self.low_water = memory, low_water

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("radio", "queued array<string>, played array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        queued, played = self.state.get() if self.state.exists() else ([], [])
        queued, played = list(queued), list(played)
        out = []
        for row in pd.concat(list(rows)).sort_values(["seq", "action", "track"]).itertuples():
            if row.action == "offer":
                if not row.available or row.track in queued or row.track in played:
                    continue
                queued.append(row.track)
            elif row.track in queued:
                queued.remove(row.track)
                played = [*(p for p in played if p != row.track), row.track][-self.memory :]
            else:
                continue
            out.append((*key, row.seq, row.action, row.batch, row.track, len(queued), len(queued) <= self.low_water))
        self.state.update((queued, played))
        yield pd.DataFrame(out, columns=["account", "station", "seq", "action", "batch", "track", "queued", "refill"])

    def close(self) -> None:
        pass


DEDUP_DDL = "account long, station string, seq long, action string, batch string, track string, queued int, refill boolean"


def wave_dedup(offers: DataFrame, memory: int = 100, low_water: int = 2) -> DataFrame:
    """Accepted tracks and plays of a stream (account, station, seq, action, batch, track, available)."""
    return offers.groupBy("account", "station").transformWithStateInPandas(BoundedDedup(memory, low_water), DEDUP_DDL, "Append", "None")


class Feedback(StatefulProcessor):
    """Player signals (seq, track, signal) to radio events: ``radioStarted`` for each station start (``radio``), ``trackStarted`` once, then one of ``skip`` and ``trackFinished``, if it had started.

    Signals: radio, started, manual-skip, finished, stop, error, source-change. Time is listened between
    ``seconds`` marks of the signals. Null and unknown signals are no events.
    """

    ENDS = {"manual-skip": "skip", "finished": "trackFinished", "stop": "skip", "error": "skip", "source-change": "skip"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "track string, began long, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        track, began, ended = self.state.get() if self.state.exists() else (None, 0, True)
        out = []
        for row in pd.concat(list(rows)).sort_values(["seq", "track"]).itertuples():
            if row.signal == "radio":
                out.append((*key, row.seq, None, "radioStarted", 0))
            elif row.signal == "started":
                if track == row.track and not ended:
                    continue
                if not ended:
                    out.append((*key, row.seq, track, "skip", row.seq - began))
                track, began, ended = row.track, row.seq, False
                out.append((*key, row.seq, track, "trackStarted", 0))
            elif row.signal in self.ENDS and not ended and row.track == track:
                out.append((*key, row.seq, track, self.ENDS[row.signal], row.seq - began))
                ended = True
        self.state.update((track, began, ended))
        yield pd.DataFrame(out, columns=["account", "seq", "track", "event", "seconds"])

    def close(self) -> None:
        pass


FEEDBACK_DDL = "account long, seq long, track string, event string, seconds long"


def wave_feedback(signals: DataFrame) -> DataFrame:
    """Radio events of a stream of player signals (account, seq, track, signal)."""
    return signals.groupBy("account").transformWithStateInPandas(Feedback(), FEEDBACK_DDL, "Append", "None")


class Retained(StatefulProcessor):
    """Keeps an account's events (at, play) of the ``days`` before its newest one, the last ``most`` of them, as state.

    Older ones go with the account's next micro-batch, so that results do not depend on the clock; an account
    that falls silent holds at most ``most``. Yields ``account, kept, oldest`` for every account of a micro-batch.
    Events without a time are not kept.
    """

    def __init__(self, days: int = 90, most: int = 5000) -> None:
        self.days, self.most = days, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("events", "at timestamp, play string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.state.get()] if self.state.exists() else []
        held += [(x.at.to_pydatetime(), x.play) for x in pd.concat(list(rows)).dropna(subset=["at"]).itertuples()]
        held.sort(key=lambda x: (x[0], x[1] or ""))
        kept = [x for x in held if x[0] >= held[-1][0] - timedelta(days=self.days)][-self.most :]
        if kept:
            self.state.put(kept)
            yield pd.DataFrame([(*key, len(kept), kept[0][0])], columns=["account", "kept", "oldest"])

    def close(self) -> None:
        pass


def retained(events: DataFrame, days: int = 90, most: int = 5000) -> DataFrame:
    """Retention as a stream over (account, at, play)."""
    return events.groupBy("account").transformWithStateInPandas(Retained(days, most), "account long, kept int, oldest timestamp", "Update", "None")


def recent_station_counts(starts: DataFrame) -> DataFrame:
    """Recents as a stream: tracks started per account and station, and the last time (update mode)."""
    return starts.groupBy("account", "station").agg(F.count(F.lit(1)).alias("count"), F.max("at").alias("last"))


def current_only(results: DataFrame, versions: DataFrame) -> DataFrame:
    """Results (key, version, ...) whose version is the latest of their key; stale ones go."""
    latest = versions.groupBy("key").agg(F.max("version").alias("version"))
    return results.join(latest, ["key", "version"], "left_semi")


def with_watermark(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Event time as a timestamp with a watermark."""
    return events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay)


def first_plays(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first event of each play, within the watermark."""
    return with_watermark(events, delay).dropDuplicatesWithinWatermark(["account", "play"])


def idempotent_sink(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch replaces its own folder, so a batch that is run again adds nothing; of rows with equal ``keys``, if any are named, one stays."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.dropDuplicates(keys) if keys else batch).write.mode("overwrite").parquet(f"{path}/micro_batch={batch_id}")

    return write


def maxima_sink(path: str, keys: list[str], values: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a small table of the largest ``values`` of each key so far; a batch that is run again changes nothing.

    Each micro-batch commits a version of the table, which :func:`maxima` reads.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows, held = batch.select(*keys, *values), versions.current(spark, path)
        if held is not None:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(held))
        versions.replace(spark, path, rows.groupBy(*keys).agg(*(F.max(v).alias(v) for v in values)).write.parquet)

    return write


def maxima(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table of a :func:`maxima_sink`; no rows before its first version."""
    held = versions.current(spark, path)
    return spark.createDataFrame([], schema) if held is None else spark.read.schema(schema).parquet(held)


def run_out(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream into a ``foreachBatch`` sink until its source has no more; from the same checkpoint it goes on where it stopped."""
    with rocksdb(stream.sparkSession):
        query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def drain(stream: DataFrame, path: str, checkpoint: str, keys: list[str], mode: str = "append") -> DataFrame:
    """Run a stream until its source has no more, and read what its sink got."""
    run_out(stream, idempotent_sink(path, keys), checkpoint, mode)
    return stream.sparkSession.read.schema(stream.schema).parquet(path).select(*stream.columns)
