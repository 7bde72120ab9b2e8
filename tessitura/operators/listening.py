"""Listening events: retention, last heard, skips, ratings, listening time, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.expr import clamp
from tessitura.operators.library import first_of

DAY_US = 86_400_000_000


def enabled_only(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows of accounts whose profile (account, enabled) is on."""
    return rows.join(profiles.where("enabled").select("account"), "account", "left_semi")


def record(events: DataFrame) -> DataFrame:
    """One event per play: the first recorded."""
    return first_of(events, ["account", "play"], ["at", "event_id"])


def retained(events: DataFrame, now: str, days: int = 90, most: int = 5000) -> DataFrame:
    """Events of the last ``days`` (inclusive), of each account the last ``most``."""
    since = F.lit(now).cast("timestamp") - F.expr(f"interval {days} days")
    order = Window.partitionBy("account").orderBy(F.desc("at"), F.desc("event_id"))
    return events.where(F.col("at") >= since).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def cleared(rows: DataFrame, clears: DataFrame) -> DataFrame:
    """Rows (account, at, ...) of a profile after the account's last clearing (account, at); ``enabled`` and the balance, kept elsewhere, stay."""
    last = clears.groupBy("account").agg(F.max("at").alias("__cleared"))
    return rows.join(last, "account", "left").where(F.col("__cleared").isNull() | (F.col("at") > F.col("__cleared"))).drop("__cleared")


def radio_requests(plays: DataFrame) -> DataFrame:
    """Requests for the next radio batch, one per play (account, station, seq, track): ``previous`` is the cursor, the track played before.

    The first request of a station has none and announces the station once (``radio_started``).
    """
    order = Window.partitionBy("account", "station").orderBy("seq")
    return plays.select("account", "station", "seq", F.lag("track").over(order).alias("previous"), (F.row_number().over(order) == 1).alias("radio_started"))


def batch_tracks(batches: DataFrame) -> DataFrame:
    """The tracks of radio batches (station, batch, sequence array<(type, track)>), in order; what is no track, or null, goes."""
    rows = batches.select("station", "batch", F.posexplode("sequence").alias("pos", "s"))
    return rows.where((F.col("s.type") == "track") & F.col("s.track").isNotNull()).select("station", "batch", "pos", F.col("s.track").alias("track"))


def last_heard(events: DataFrame) -> DataFrame:
    """``account, id, at``: when each track was heard last (plays of zero seconds don't count)."""
    return events.where("seconds > 0").groupBy("account", "id").agg(F.max("at").alias("at"))


def last_track(events: DataFrame) -> DataFrame:
    """Each account's most recently heard track; of equal times the one that came first."""
    heard = events.where("seconds > 0").groupBy("account", "id").agg(F.max("at").alias("at"), F.min("event_id").alias("first"))
    best = heard.groupBy("account").agg(F.max(F.struct("at", (-F.col("first")).alias("back"), "id")).alias("b"))
    return best.select("account", F.col("b.id").alias("id"))


def skip_counts(events: DataFrame, under: float = 30.0) -> DataFrame:
    """Early manual skips per track, plays of zero seconds included."""
    early = (F.col("cause") == "manual-skip") & (F.col("seconds") < under)
    return events.where(early).groupBy("account", "id").agg(F.count(F.lit(1)).alias("skips"))


def ratings(changes: DataFrame, most: int = 2000) -> DataFrame:
    """The last rating of each track; zero clears; of each account the newest ``most``."""
    last = changes.groupBy("account", "id").agg(F.max(F.struct("at", "event_id", "value")).alias("l")).where("l.value <> 0")
    rows = last.select("account", "id", F.col("l.value").alias("value"), F.col("l.at").alias("at"), F.col("l.event_id").alias("event_id"))
    order = Window.partitionBy("account").orderBy(F.desc("at"), F.desc("event_id"))
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).select("account", "id", "value", "at")


def listening_time(ticks: DataFrame, cap_seconds: float = 1.0) -> DataFrame:
    """``account, seconds, intervals``: time that passed in intervals that began while playing, each at most ``cap_seconds``.

    ``ticks`` has (account, at, event_id, playing).
    """
    order = Window.partitionBy("account").orderBy("at", "event_id")
    gap_us = F.unix_micros("at") - F.unix_micros(F.lag("at").over(order))
    rows = ticks.select("account", (gap_us / F.lit(1e6)).alias("gap"), F.lag("playing").over(order).alias("was"))
    seen = F.when(F.col("was"), clamp("gap", 0.0, cap_seconds)).otherwise(F.lit(0.0))
    return rows.groupBy("account").agg(F.coalesce(F.sum((seen * 1000).cast("long")), F.lit(0)).alias("milliseconds"), F.count_if(F.col("was") & F.col("gap").isNotNull()).alias("intervals"))


def recent_stations(starts: DataFrame) -> DataFrame:
    """``account, station, count, last``: once per started track."""
    return starts.groupBy("account", "station").agg(F.count(F.lit(1)).alias("count"), F.max("at").alias("last"))


def batch_counters(received: DataFrame, played: DataFrame) -> DataFrame:
    """Batches received and distinct batches played, per station."""
    a = received.groupBy("station").agg(F.countDistinct("batch").alias("received"))
    b = played.groupBy("station").agg(F.countDistinct("batch").alias("played"))
    return a.join(b, "station", "left").select("station", "received", F.coalesce("played", F.lit(0)).alias("played"))


def play_sessions(signals: DataFrame) -> DataFrame:
    """Sessions from signals (account, at, event_id, signal): one starts at ``started``, and ends at the next signal of any kind.

    ``account, session, began, ended, cause``; a session that a new start ends has the cause source-change,
    one that is still open none.
    """
    order = Window.partitionBy("account").orderBy("at", "event_id")
    rows = signals.withColumn("next_at", F.lead("at").over(order)).withColumn("next_signal", F.lead("signal").over(order))
    opened = rows.where("signal = 'started'")
    cause = F.when(F.col("next_signal") == "started", "source-change").otherwise(F.col("next_signal"))
    return opened.select("account", F.row_number().over(order).alias("session"), F.col("at").alias("began"), F.col("next_at").alias("ended"), cause.alias("cause"))


def accepted_events(events: DataFrame, acks: DataFrame, held: int = 64) -> DataFrame:
    """Player events (session, n, entry, name) as a session sees them once its entry is acknowledged (session, entry, n).

    Events before the acknowledgement are held, the last ``held`` of them whatever their entry, and replayed then;
    events of another entry are dropped.
    """
    rows = events.join(acks.select("session", F.col("entry").alias("own"), F.col("n").alias("ack")), "session")
    early = F.col("n") < F.col("ack")
    order = Window.partitionBy("session", early).orderBy(F.desc("n"))
    return rows.withColumn("__n", F.row_number().over(order)).where((F.col("entry") == F.col("own")) & (~early | (F.col("__n") <= held))).select("session", "n", "entry", "name", early.alias("replayed"))


def seed_list(actions: DataFrame, most: int = 10) -> DataFrame:
    """Seeds after appends (account, seq, id): distinct ids, each where it came last, the last ``most``; position zero is the oldest."""
    last = actions.groupBy("account", "id").agg(F.max("seq").alias("seq"))
    newest = Window.partitionBy("account").orderBy(F.desc("seq"), "id")
    kept = last.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= most)
    oldest = Window.partitionBy("account").orderBy("seq", F.desc("id"))
    return kept.select("account", "id", (F.row_number().over(oldest) - 1).alias("pos"))


def play_reports(plays: DataFrame) -> DataFrame:
    """Play reports (play, id, album_id, started, length, seconds): the length in whole seconds; without an album or listening they are rejected."""
    good = (F.coalesce("album_id", F.lit("")) != "") & (F.col("seconds") > 0)
    return plays.select("play", "id", "album_id", "started", F.round("length").cast("long").alias("length"), "seconds", good.alias("accepted"))
