"""The history of what was played, folded in blocks, so that one long session is work for many tasks.

Entries stand at places that never change: ``start`` puts one behind the current place and removes what is further
right, ``previous`` at the leftmost entry puts one before it. Then all that a block does is known from three numbers,
the current, the leftmost and the rightmost place before it. From its first ``start`` on, only one of them matters,
how far the current place is from the left end, and only up to how far left the block goes: a table of that size sums
a block up. The few actions before the first ``start`` travel as they are. So

1. every block sums itself up, in parallel;
2. the summaries of a session, numbers only, give the three numbers before each of its blocks;
3. every block is folded from there, in parallel, and gives the entries it adds and the lowest place it removes;
4. an entry stays if no later block of its session removes it; a session's entries in the order of places are its history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, PREPEND, BACK, FORWARD = range(4)
#: (current, leftmost, rightmost) of a history without entries.
NOTHING = (0, 1, 0)


def moved(at: int, left: int, right: int, move: int) -> tuple[int, int, int]:
    """The three numbers after one move."""
    if right < left:
        return (1, 1, 1) if move == START else (0, 0, 0) if move == PREPEND else (at, left, right)
    if move == START:
        return at + 1, left, at + 1
    if move == PREPEND:
        return at - 1, min(left, at - 1), right
    if move == BACK:
        return max(at - 1, left), left, right
    return min(at + 1, right), left, right


def summary(moves: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(moves before the first start, table) of a block.

    The table has a row per distance of the current place from the left end before the start, -1 for a history
    without entries, up to one from which on the block never meets the left end: how far the current place moves, and its
    distances from both ends then. It is empty for a block without a start.
    """
    starts = np.flatnonzero(moves == START)
    if not len(starts):
        return moves.tolist(), np.zeros((0, 3), np.int64)
    rest = moves[starts[0] :].tolist()
    at = right = low = 0
    for move in rest:  # far from the left end
        at, _, right = moved(at, -(1 << 62), right, BACK if move == PREPEND else move)
        low = min(low, at)
    before = np.arange(-1, 1 - low)
    step, from_left, from_right = np.zeros_like(before), before.copy(), np.zeros_like(before)
    for move in rest:
        if move == START:
            step, from_left, from_right = step + 1, from_left + 1, np.zeros_like(before)
        elif move == FORWARD:
            can = from_right > 0
            step, from_left, from_right = step + can, from_left + can, from_right - can
        else:
            can = (from_left > 0) | (move == PREPEND)
            step, from_left, from_right = step - can, np.maximum(from_left - 1, 0), from_right + can
    return moves[: starts[0]].tolist(), np.stack([step, from_left, from_right], axis=1)


def after(state: tuple[int, int, int], first: list[int], table: np.ndarray) -> tuple[int, int, int]:
    """The three numbers after a block, by its summary."""
    for move in first:
        state = moved(*state, move)
    if not len(table):
        return state
    at, left, right = state
    distance = -1 if right < left else at - left
    row = table[min(distance + 1, len(table) - 1)]
    at += int(row[0])
    from_left = int(row[1]) + max(0, distance + 2 - len(table))
    return at, at - from_left, at + int(row[2])


def folded(state: tuple[int, int, int], moves: list[int], ids: list[str | None]) -> tuple[dict[int, str | None], int]:
    """(entries by place, lowest place removed) that a block leaves; the place is far right if it removes none."""
    entries: dict[int, str | None] = {}
    lowest = last = 1 << 62
    at, left, right = state
    for move, track in zip(moves, ids, strict=True):
        before, empty = left, right < left
        at, left, right = moved(at, left, right, move)
        if move == START:
            lowest = min(lowest, at)
            if entries:
                for place in range(at, last + 1):
                    entries.pop(place, None)
            entries[at], last = track, at
        elif move == PREPEND and (empty or at < before):
            last = max(last, at) if entries else at
            entries[at] = track
    return entries, lowest


def by_run(keys: list[str], each: Callable[..., dict], rows: int = 1 << 14):
    """A function for ``mapInArrow`` over rows sorted by ``keys``: ``each(*key, rows)`` gives the columns of one run of equal keys.

    Results of about ``rows`` rows go out together. A run that goes on in the next batch is held until it ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: dict[str, list] = {}
        last = None

        def ended() -> None:
            table = pa.Table.from_batches(held)
            for name, values in each(*last, table).items():
                out.setdefault(name, []).extend(values)
            held.clear()

        def batch_of(schema: pa.Schema) -> pa.RecordBatch:
            kinds = {"seq_id": schema.field("seq_id").type, "block": pa.int32(), "first": pa.list_(pa.int32()), "table": pa.list_(pa.int64()), "id": pa.string(), "cut": pa.bool_()}
            found = pa.RecordBatch.from_pydict({n: pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()})
            out.clear()
            return found

        for batch in batches:
            if not batch.num_rows:
                continue
            found = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            start = 0
            for stop in [*(i for i in range(1, len(found)) if found[i] != found[i - 1]), len(found)]:
                if held and found[start] != last:
                    ended()
                    if len(next(iter(out.values()))) >= rows:
                        yield batch_of(batch.schema)
                last = found[start]
                held.append(batch.slice(start, stop - start))
                start = stop
        if held:
            schema = held[0].schema
            ended()
            yield batch_of(schema)

    return run


def split_fold(actions: DataFrame, folder: str) -> DataFrame:
    """``seq_id, history array<string>, cursor`` of actions (seq_id, n, action, id), each session dealt over blocks.

    Equal to :func:`~tessitura.operators.sequence.history_fold` one by one. ``folder`` is a new path of the shared
    store, for the blocks and their results.
    """
    spark, key = actions.sparkSession, actions.schema["seq_id"].dataType.simpleString()
    move = F.when(F.col("action") == "start", START).when(F.col("action") == "forward", FORWARD).when(F.col("action") == "previous", F.when(F.col("id").isNull(), BACK).otherwise(PREPEND))
    rows = actions.select("seq_id", "n", "action", F.col("id").cast("string").alias("id"), move.alias("move"))
    dealt = rows.repartitionByRange("seq_id", "n").sortWithinPartitions("seq_id", "n", "action", "id")
    dealt = dealt.select("seq_id", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("order"), F.coalesce("move", F.lit(FORWARD + 1)).alias("move"), "id")
    dealt.write.parquet(f"{folder}/blocks")
    blocks = spark.read.schema(dealt.schema).parquet(f"{folder}/blocks")

    def sum_up(session, block, rows: pa.Table) -> dict:
        first, table = summary(rows["move"].to_numpy()[rows["move"].to_numpy() <= FORWARD])
        return {"seq_id": [session], "block": [block], "first": [first], "table": [table.ravel().tolist()]}

    def chain(session, rows: pa.Table) -> dict:
        states = [NOTHING]
        for first, table in zip(rows["first"].to_pylist(), rows["table"].to_pylist(), strict=True):
            states.append(after(states[-1], first, np.asarray(table, np.int64).reshape(-1, 3)))
        at, left, right = map(list, zip(*states, strict=True))
        return {"seq_id": [session] * len(states), "block": [*rows["block"].to_pylist(), -1], "at": at, "left": left, "right": right}

    def fold(session, block, rows: pa.Table) -> dict:
        rows = rows.filter(pc.less_equal(rows["move"], FORWARD))
        if not len(rows):
            return {"seq_id": [], "block": [], "place": [], "id": [], "cut": []}
        state = tuple(rows[c][0].as_py() for c in ("at", "left", "right"))
        entries, lowest = folded(state, rows["move"].to_pylist(), rows["id"].to_pylist())
        n = len(entries) + 1
        return {"seq_id": [session] * n, "block": [block] * n, "place": [*entries, lowest], "id": [*entries.values(), None], "cut": [False] * (n - 1) + [True]}

    # A session is dealt by its blocks, which lie in order; runs of equal keys go through a task as a stream.
    own = blocks.repartition("seq_id", "block").sortWithinPartitions("seq_id", "block", "order")
    sums = own.mapInArrow(by_run(["seq_id", "block"], sum_up), f"seq_id {key}, block int, first array<int>, table array<long>")
    states = sums.repartition("seq_id").sortWithinPartitions("seq_id", "block").mapInArrow(by_run(["seq_id"], chain), f"seq_id {key}, block int, at long, left long, right long")
    states.write.parquet(f"{folder}/states")
    states = spark.read.schema(states.schema).parquet(f"{folder}/states")

    at = blocks.join(states, ["seq_id", "block"]).repartition("seq_id", "block").sortWithinPartitions("seq_id", "block", "order")
    parts = at.mapInArrow(by_run(["seq_id", "block"], fold), f"seq_id {key}, block int, place long, id string, cut boolean")
    parts.write.parquet(f"{folder}/entries")
    parts = spark.read.schema(parts.schema).parquet(f"{folder}/entries")
    later = Window.partitionBy("seq_id").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    cuts = parts.where("cut").select("seq_id", "block", F.min("place").over(later).alias("removed"))  # a row per block
    stay = parts.where("NOT cut").join(cuts, ["seq_id", "block"]).where(F.col("removed").isNull() | (F.col("place") < F.col("removed")))
    histories = stay.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("entries"))
    last = states.where("block = -1")
    cursor = F.when(F.col("right") < F.col("left"), -1).otherwise(F.col("at") - F.col("left")).cast("int")
    history = F.coalesce(F.transform("entries", lambda e: e["id"]), F.array().cast("array<string>"))
    return last.join(histories, "seq_id", "left").select("seq_id", history.alias("history"), cursor.alias("cursor"))
