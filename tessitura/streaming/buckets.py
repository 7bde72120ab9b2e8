"""Folds over many keys in few calls: the keys of a bucket share one value of state.

``transformWithStateInPandas`` asks the state store over a socket for each key and kind of state, which takes
milliseconds. Here a group is a bucket of keys, so a micro-batch costs one read and one write per bucket that it
touches, and each key's state is a Python object in the bucket's. The number of buckets belongs to a checkpoint.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BUCKETS = 1024


class Bucketed(StatefulProcessor):
    """Subclasses name the ``columns`` of their rows behind the key, its place first in each, and those of the result (``out``)."""

    columns: list[str] = []
    out: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("keys", "held binary")

    def fold(self, key: str | None, state: Any, rows: list[tuple], now_ms: int, found: list[tuple]) -> Any:
        """The state of a key (None: nothing is held) after its new rows; results go to ``found``."""
        raise NotImplementedError

    def held(self) -> dict:
        got = self.value.get()
        return {} if got is None else pickle.loads(got[0])

    def hold(self, states: dict) -> None:
        self.value.update((pickle.dumps(states, pickle.HIGHEST_PROTOCOL),))

    def _rows(self, parts: Iterator[pd.DataFrame]) -> dict[str | None, list[tuple]]:
        """New rows of each key, in the order they come in."""
        new: dict[str | None, list[tuple]] = {}
        for part in parts:
            for key, *row in zip(*(part[c].tolist() for c in ("key", *self.columns)), strict=True):
                new.setdefault(key, []).append(tuple(row))
        return new

    def _folded(self, states: dict, new: dict[str | None, list[tuple]], now_ms: int) -> list[tuple]:
        results = []
        for key, rows in new.items():
            found: list[tuple] = []
            state = self.fold(key, states.get(key), rows, now_ms, found)
            if state is None:
                states.pop(key, None)
            else:
                states[key] = state
            results += [(key, *r) for r in found]
        return results

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        states = self.held()
        results = self._folded(states, self._rows(rows), 0)
        self.hold(states)
        if results:
            yield self.frame(results)

    def frame(self, results: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(results, columns=["key", *self.out])

    def close(self) -> None:
        pass


def bucketed(rows: DataFrame, key: str, fold: Bucketed, ddl: str, time: str = "None", buckets: int = BUCKETS) -> DataFrame:
    """``fold`` over a stream; the result has the key under its name and type, then the columns of ``ddl``.

    Keys travel as strings. Columns that may be null must not be numbers, which pandas would make floats.
    """
    kind = rows.schema[key].dataType
    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).cast("string").alias("key"), *(c for c in rows.columns if c != key))
    found = dealt.groupBy("bucket").transformWithStateInPandas(fold, f"key string, {ddl}", "Append", time)
    return found.select(F.col("key").cast(kind).alias(key), *found.columns[1:])
