"""Ordered sequences: queues, their neighbours, shuffles, and the history of what was played.

A sequence is a relation with (seq_id, pos); nothing relies on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.expr import base_id
from tessitura.operators.history import split_fold
from tessitura.operators.library import ordered_distinct
from tessitura.sources.shared import shared_path


def dealt(rows: DataFrame, count: int, *keys: str, per_task: int = 250_000) -> DataFrame:
    """``rows``, about ``count`` of them, dealt by ``keys`` over tasks of about ``per_task`` rows, which adaptive execution does not put together again."""
    tasks = -(-count // per_task)
    return rows.repartition(tasks, *keys) if tasks > 1 else rows


def _with_known(rows: DataFrame, known: DataFrame, wanted: DataFrame, broadcast_rows: int) -> DataFrame:
    """``rows`` (seq_id, id, ...) with the columns of ``known`` (__id, ...), null where it lacks the id.

    A few ids may stand in most rows, so rows are not dealt by id: ``known`` is reduced to the ids ``wanted`` and
    broadcast. Above ``broadcast_rows`` both are dealt by id, which adaptive execution may split, and then by sequence.
    """
    held = known.join(wanted.select(F.col("id").alias("__id")).distinct(), "__id", "left_semi")
    if held.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(held), F.col("id") == F.col("__id"), "left")
    return rows.join(held, F.col("id") == F.col("__id"), "left").repartition("seq_id")


def queue_build(ids: DataFrame, loaded: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """A queue of all distinct full ids in order (seq_id, pos, full_id), with loaded rows (id, title, available, kind).

    Only tracks count; ids that are not loaded are placeholders. ``base_pos`` is the canonical place
    of a base id: of several full ids of one base, the last one's.
    """
    first = ordered_distinct(ids, ["seq_id"], "full_id", "pos")
    order = Window.partitionBy("seq_id").orderBy("pos")
    queue = first.select("seq_id", (F.row_number().over(order) - 1).alias("pos"), "full_id", base_id("full_id").alias("id"))
    queue = queue.withColumn("base_pos", F.max("pos").over(Window.partitionBy("seq_id", "id")))
    known = loaded.where("kind = 'track'").select(F.col("id").alias("__id"), "title", "available")
    rows = _with_known(queue, known, ids.select(base_id("full_id").alias("id")), broadcast_rows)
    return rows.select("seq_id", "pos", "full_id", "id", F.coalesce("title", F.concat(F.lit("TRACK "), F.col("id"))).alias("title"), F.coalesce("available", F.lit(True)).alias("available"), "base_pos")


def queue_rows(queue: DataFrame, current: DataFrame) -> DataFrame:
    """What a queue shows: rows from the current one (seq_id, cur) on, with ``is_current``."""
    rows = queue.join(current, "seq_id").where("pos >= cur")
    return rows.select("seq_id", "pos", "id", (F.col("pos") == F.col("cur")).alias("is_current"))


def radio_rows(current: DataFrame, upcoming: DataFrame) -> DataFrame:
    """The track that plays, as position -1, before those to come."""
    now = current.select("seq_id", F.lit(-1).cast("int").alias("pos"), "id", F.lit(True).alias("is_current"))
    return now.unionByName(upcoming.select("seq_id", F.col("pos").cast("int").alias("pos"), "id", F.lit(False).alias("is_current")))


def neighbours(queue: DataFrame) -> DataFrame:
    """The next and the previous available position of every row; -1 if there is none."""
    order = Window.partitionBy("seq_id").orderBy("pos")
    own = F.when(F.col("available"), F.col("pos"))
    after = F.first(own, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    before = F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return queue.select("seq_id", "pos", F.coalesce(after, F.lit(-1)).alias("next_pos"), F.coalesce(before, F.lit(-1)).alias("previous_pos"))


def _renumber(rows: DataFrame, *order: Column) -> DataFrame:
    place = Window.partitionBy("seq_id").orderBy(*order)
    return rows.withColumn("new_pos", F.row_number().over(place) - 1)


def restore_order(queue: DataFrame, current: DataFrame, n: str = "base_pos") -> DataFrame:
    """Rows after the current one in canonical order, unknown ones last; the others keep their places."""
    rows = queue.join(current, "seq_id")
    rest = F.col("pos") > F.col("cur")
    return _renumber(rows, rest, F.when(rest, F.coalesce(F.col(n), F.lit(2**31 - 1))).otherwise(F.col("pos")), F.col("pos")).select("seq_id", "pos", "id", "new_pos")


def shuffle_key(seed: int, full_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), full_id))


def shuffle_rest(queue: DataFrame, current: DataFrame, seed: int) -> DataFrame:
    """Rows after the current one in an order that the seed fixes; a current position of -1 shuffles all."""
    rows = queue.join(current, "seq_id")
    rest = F.col("pos") > F.col("cur")
    return _renumber(rows, rest, F.when(rest, shuffle_key(seed, F.col("full_id"))), F.col("pos")).select("seq_id", "pos", "id", "new_pos")


def wrap_around(queue: DataFrame, current: DataFrame, seed: int | None) -> DataFrame:
    """The queue anew when it repeats: canonical order, or shuffled without the current track at its head."""
    rows = queue.join(current, "seq_id")
    if seed is None:
        return _renumber(rows, F.coalesce("base_pos", F.lit(2**31 - 1)), F.col("pos")).select("seq_id", "pos", "id", "new_pos")
    drawn = _renumber(rows, shuffle_key(seed, F.col("full_id")), F.col("pos"))
    size = F.count(F.lit(1)).over(Window.partitionBy("seq_id"))
    head = F.max(F.when((F.col("new_pos") == 0) & (F.col("pos") == F.col("cur")), 1).otherwise(0)).over(Window.partitionBy("seq_id"))
    turned = F.when((head == 1) & (size > 1), F.pmod(F.col("new_pos") - 1, size)).otherwise(F.col("new_pos"))
    return drawn.select("seq_id", "pos", "id", turned.cast("int").alias("new_pos"))


def start_position(queue: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where play starts: the first available row from the first row of the wanted id (seq_id, id, shuffled) on.

    Shuffled queues start at their first available row. -1 if no row is left.
    """
    found = queue.join(wanted.select("seq_id", F.col("id").alias("wanted"), "shuffled"), "seq_id")
    first = F.min(F.when(F.col("id") == F.col("wanted"), F.col("pos"))).over(Window.partitionBy("seq_id"))
    from_pos = F.when(F.col("shuffled"), F.lit(0)).otherwise(F.coalesce(first, F.lit(0)))
    return found.withColumn("from_pos", from_pos).groupBy("seq_id").agg(F.coalesce(F.min(F.when(F.col("available") & (F.col("pos") >= F.col("from_pos")), F.col("pos"))), F.lit(-1)).alias("start_pos"))


def look_ahead(queue: DataFrame, current: DataFrame, n: int = 10) -> DataFrame:
    """Of the next ``n`` rows those without a duration, whose metadata should be fetched."""
    rows = queue.join(current, "seq_id")
    return rows.where((F.col("pos") > F.col("cur")) & (F.col("pos") <= F.col("cur") + n) & (F.coalesce("duration", F.lit(0.0)) == 0)).select("seq_id", "pos", "id")


def refresh(queue: DataFrame, fresh: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """Rows replaced by fresh metadata (id, title, available) where there is any."""
    new = fresh.select(F.col("id").alias("__id"), F.col("title").alias("__title"), F.col("available").alias("__available"))
    return _with_known(queue, new, queue, broadcast_rows).select("seq_id", "pos", "id", F.coalesce("__title", "title").alias("title"), F.coalesce("__available", "available").alias("available"))


def extend(queue: DataFrame, rows: DataFrame, count: int = 0) -> DataFrame:
    """``rows`` (seq_id, pos, id, available) that a queue lacks and that are available, after its last position.

    Both sides, together about ``count`` rows, are dealt by sequence once. An id or a sequence that is null is like no other.
    """
    old = queue.select("seq_id", F.col("pos").cast("int").alias("pos"), "id", F.lit(False).alias("new"))
    both = dealt(old.unionByName(rows.where("available").select("seq_id", F.col("pos").cast("int").alias("pos"), "id", F.lit(True).alias("new"))), count, "seq_id")
    alone = F.col("new") & (F.col("seq_id").isNull() | F.col("id").isNull())
    place = F.row_number().over(Window.partitionBy("seq_id", "id", "alone").orderBy("new", "pos"))
    first = both.withColumn("alone", alone).withColumn("place", place).where("NOT new OR place = 1")
    size = F.max(F.when(~F.col("new") & F.col("seq_id").isNotNull(), F.col("pos") + 1)).over(Window.partitionBy("seq_id"))
    after = F.row_number().over(Window.partitionBy("seq_id", "new").orderBy("pos", "id")) - 1
    sized = first.withColumn("size", size).withColumn("after", after)
    return sized.select("seq_id", F.when(F.col("new"), F.coalesce("size", F.lit(0)) + F.col("after")).otherwise(F.col("pos")).cast("int").alias("pos"), "id")


def history_positions(history: DataFrame, queue: DataFrame) -> DataFrame:
    """The first queue position of each id in a history (seq_id, at, id); -1 if it is not in the queue."""
    first = queue.groupBy("seq_id", "id").agg(F.min("pos").alias("pos"))
    return history.join(first, ["seq_id", "id"], "left").select("seq_id", "at", "id", F.coalesce("pos", F.lit(-1)).alias("pos"))


def history_fold(actions: DataFrame, split_over: int = 1_000_000) -> DataFrame:
    """:func:`whole_fold`, but sessions of more than ``split_over`` actions are folded in blocks, by :func:`~tessitura.operators.history.split_fold`."""
    spark = actions.sparkSession
    long = actions.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_over).select("seq_id")
    if long.isEmpty():
        return whole_fold(actions)
    split = split_fold(actions.join(long, "seq_id", "left_semi"), shared_path(spark, "history"))
    return whole_fold(actions.join(long, "seq_id", "left_anti")).unionByName(split)


def whole_fold(actions: DataFrame) -> DataFrame:
    """History after actions (seq_id, n, action, id): ``seq_id, history array<string>, cursor``.

    ``start`` of an id cuts what lies after the cursor and appends it; ``previous`` and ``forward``
    move the cursor; ``previous`` at the first entry with an id puts that id, the queue's
    predecessor, before all others. A fold over all actions of one session, in order: rows sorted by
    session and n go through a task one batch at a time, so only the history itself is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, before, after, cursor = None, [], [], -1  # ids put before all others (last first), and those appended

        def folded() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([session[0]], kind), pa.array([before[::-1] + after], pa.list_(pa.string())), pa.array([cursor], pa.int32())], names=["seq_id", "history", "cursor"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, action, track in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if session is None or session[0] != key:
                    if session is not None:
                        yield folded()
                    session, before, after, cursor = (key,), [], [], -1
                if action == "start":
                    keep = cursor + 1 - len(before)
                    if keep < 0:
                        del before[:-keep]
                    del after[max(keep, 0) :]
                    after.append(track)
                    cursor = len(before) + len(after) - 1
                elif action == "previous" and cursor > 0:
                    cursor -= 1
                elif action == "previous" and track is not None:
                    before.append(track)
                    cursor = 0
                elif action == "forward" and cursor + 1 < len(before) + len(after):
                    cursor += 1
        if session is not None:
            yield folded()

    rows = actions.select("seq_id", "action", F.col("id").cast("string").alias("id"), "n").repartition("seq_id").sortWithinPartitions("seq_id", "n", "action", "id").select("seq_id", "action", "id")
    return rows.mapInArrow(run, f"seq_id {actions.schema['seq_id'].dataType.simpleString()}, history array<string>, cursor int")


def advance(natural: str | Column, repeat: str | Column, forward: str | Column, following: str | Column) -> Column:
    """What happens at the end of a track or on "next": REPLAY, HISTORY, NEXT, WRAP or STOP.

    Repeat-one replays on a natural end only; a manual step takes the history's forward entry first.
    """
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return (
        F.when(c(natural) & (c(repeat) == "one"), "REPLAY").when(~c(natural) & c(forward), "HISTORY").when(c(following) >= 0, "NEXT")
        .when(c(repeat) == "all", "WRAP").otherwise("STOP")
    )
