"""The player behind a radio source: queues without repeats, plays, asks for more when few are left, halts at errors.

Its state is a small table per version (:mod:`tessitura.sources.versions`): the queue with the last tracks played, and
a control row per station, whose turn the source reads as its offset. A micro-batch that is run again finds its number in
the version and changes nothing. The source brings a stretch of answers per station; a micro-batch is one pass over
the stations, grouped, that takes them in by the rules (:mod:`tessitura.streaming.station`) and writes the state once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.sources import radio_source, versions
from tessitura.streaming.station import Rules, Station

QUEUE = "station string, seq long, batch string, track string, played boolean"
CONTROL = "station string, turn long, previous string, attempt int, halted boolean"
#: One table holds both, and the tracks that a micro-batch accepts (part "out"); its Arrow schema is the source's.
HELD = "station string, seq long, batch string, track string, played boolean, turn long, previous string, attempt int, halted boolean, part string"


def _played(low_water: int, memory: int, again: int = 0, most: int = 1) -> Callable[[pa.Table], pa.Table]:
    """A station's rows of all parts, and what arrived for it (part "new"), to its rows after the micro-batch."""
    rules = Rules(low_water, memory, again, most)

    def step(rows: pa.Table) -> pa.Table:
        of: dict[str, list[dict]] = {"queue": [], "control": [], "new": []}
        for row in rows.to_pylist():
            of[row["part"]].append(row)
        answers: dict[int, list[dict]] = {}
        for row in of["new"]:
            answers.setdefault(row.get("ask", 0), []).append(row)
        control, going = of["control"][0], False
        station = Station(rules, of["queue"], control)
        for _, answer in sorted(answers.items()):
            going = station.hear(answer)
        # A stretch that did not end by itself ended by its rows, and the next one is asked for.
        turn = control["turn"] + (going and len(of["new"]) >= rules.most)
        found = [{"part": "control", "turn": turn, "previous": station.previous, "attempt": station.attempt, "halted": station.halted}]
        for part, played, tracks in (("queue", True, station.played), ("queue", False, station.waiting), ("out", False, station.accepted)):
            found += [{"part": part, "seq": seq, "batch": batch, "track": track, "played": played} for seq, batch, track in tracks]
        names = radio_source.HELD.names
        return pa.Table.from_pylist([{c: r.get(c) for c in names} | {"station": control["station"]} for r in found], schema=radio_source.HELD)

    return step


class Player:
    """A player of stations under ``path``: plays down to ``low_water`` queued tracks, at least one, then asks again; a track may return when ``memory`` others were played since.

    An error halts a station. It is asked again ``again`` times for one cursor at once, and then by :meth:`retry`. In one
    micro-batch a station asks until it has about ``most`` rows of answers.
    """

    def __init__(self, spark: SparkSession, path: str, low_water: int = 2, memory: int = 100, again: int = 0, most: int = 50_000) -> None:
        self.spark, self.path, self.rules = spark, path.rstrip("/"), Rules(low_water, memory, again, most)

    def _table(self, part: str, folder: str | None) -> DataFrame:
        columns = self.spark.createDataFrame([], QUEUE if part == "queue" else CONTROL).columns
        held = self.spark.createDataFrame([], HELD) if folder is None else self.spark.read.schema(HELD).parquet(f"{self.path}/{folder}")
        return held.where(F.col("part") == part).select(*columns)

    def _state(self) -> tuple[int, dict]:
        return versions.pointer(self.spark, self.path) or (-1, {"data": None, "batch": -1})

    def _write(self, rows: DataFrame) -> str:
        name = f"data-{uuid.uuid4().hex}"
        rows.write.partitionBy("part").parquet(f"{self.path}/{name}")
        return name

    def _commit(self, base: int, batch: int, queue: DataFrame, control: DataFrame) -> None:
        rows = queue.withColumn("part", F.lit("queue")).unionByName(control.withColumn("part", F.lit("control")), allowMissingColumns=True)
        versions.commit(self.spark, self.path, {"data": self._write(rows), "batch": batch}, base)

    def start(self, stations: DataFrame) -> None:
        """Ask for the first batch of stations (station) that do not play yet."""
        base, state = self._state()
        control = self._table("control", state["data"])
        new = stations.select("station").distinct().join(control, "station", "left_anti")
        fresh = new.select("station", F.lit(0).cast("long").alias("turn"), F.lit(None).cast("string").alias("previous"), F.lit(0).alias("attempt"), F.lit(False).alias("halted"))
        self._commit(base, state["batch"], self._table("queue", state["data"]), control.unionByName(fresh))

    def halted(self) -> DataFrame:
        """Stations that an error has halted."""
        return self._table("control", self._state()[1]["data"]).where("halted").select("station")

    def retry(self) -> None:
        """Ask again for what the halted stations asked for."""
        base, state = self._state()
        control = self._table("control", state["data"])
        again = control.withColumn("turn", F.col("turn") + F.col("halted").cast("long")).withColumn("halted", F.lit(False))
        self._commit(base, state["batch"], self._table("queue", state["data"]), again)

    def sink(self, out: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch`` over a radio source; accepted tracks go to ``out``."""

        def play(arrived: DataFrame, batch_id: int) -> None:
            base, state = self._state()
            if batch_id <= state["batch"]:
                return
            held = self.spark.read.schema(HELD).parquet(f"{self.path}/{state['data']}").where("part <> 'out'")
            rows = held.unionByName(arrived.drop("n").withColumn("part", F.lit("new")), allowMissingColumns=True)
            name = self._write(rows.groupBy("station").applyInArrow(_played(**asdict(self.rules)), HELD))
            accepted = self.spark.read.schema(HELD).parquet(f"{self.path}/{name}").where("part = 'out'")
            accepted.select("station", "seq", "batch", "track").write.mode("overwrite").parquet(f"{out}/micro_batch={batch_id}")
            versions.commit(self.spark, self.path, {"data": name, "batch": batch_id}, base)

        return play

    def run(self, service: str, out: str, checkpoint: str) -> None:
        """Play until no station asks for more: each has played what the service has, or is halted. Goes on from its checkpoint."""
        self.spark.dataSource.register(radio_source.RadioSource)
        stream = self.spark.readStream.format("radio").options(service=service, player=self.path, **asdict(self.rules)).load()
        query = stream.writeStream.foreachBatch(self.sink(out)).option("checkpointLocation", checkpoint).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
