"""Radio stations as a streaming source: each micro-batch is a stretch of requests per station, each for the batch that follows a track.

A station's requests follow each other, and the cursor of a request is the track that was played last. So a stretch
begins where the player (:mod:`tessitura.streaming.player`) has committed the station, and goes on by the player's
rules (:mod:`tessitura.streaming.station`) from answer to answer, until nothing more comes, an error halts the station or
the stretch has its number of rows. The offset of a station is the number of its stretch, which the player commits: while
it has not taken in a stretch, or a station is halted, that stays and nothing is asked. Stretches run on executors, a
partition each; the driver reads one small row per station.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tessitura.streaming.station import Rules, Station

SCHEMA = "station string, ask int, n int, batch string, pos int, track string, available boolean, error string"

#: The player's table: of each station its queue and a control row, and the tracks that a micro-batch accepts (part "out").
HELD = pa.schema([("station", pa.string()), ("seq", pa.int64()), ("batch", pa.string()), ("track", pa.string()), ("played", pa.bool_()), ("turn", pa.int64()), ("previous", pa.string()), ("attempt", pa.int32()), ("halted", pa.bool_()), ("part", pa.string())])


def at(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, or of a local path."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


def committed(player: str) -> ds.Dataset | None:
    """The last version of the player's table."""
    fs, root = at(player)
    names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(f"{root}/_versions", allow_not_found=True)) if f.base_name.isdigit())
    if not names:
        return None
    with fs.open_input_stream(f"{root}/_versions/{names[-1]}") as f:
        folder = json.loads(f.read())["data"]
    return ds.dataset(f"{root}/{folder}", schema=HELD, filesystem=fs, format="parquet", partitioning=ds.partitioning(pa.schema([("part", pa.string())]), flavor="hive"))


class Service:
    """The batches of one station, read once for a stretch."""

    def __init__(self, path: str, station: str) -> None:
        fs, root = at(path)
        table = ds.dataset(root, filesystem=fs, format="parquet", partitioning=ds.partitioning(pa.schema([("station", pa.string())]), flavor="hive"))
        rows = table.to_table(columns=["n", "batch", "pos", "track", "available", "fails"], filter=ds.field("station") == station)
        self.rows = rows.sort_by([("n", "ascending"), ("pos", "ascending")]).combine_chunks()
        self.n = self.rows.column("n").to_numpy()
        given = self.rows.filter(ds.field("available")).select(["track", "n"])[::-1]
        #: The first batch that gives a track.
        self.first = dict(zip(given.column("track").to_pylist(), given.column("n").to_pylist(), strict=True))

    def answer(self, previous: str | None, attempt: int) -> list[dict]:
        """The batch behind ``previous``, or the first one; one row with ``error`` if it fails more often than ``attempt`` times."""
        n = 0 if previous is None else self.first.get(previous, -1) + 1
        begin, end = np.searchsorted(self.n, [n, n + 1])
        rows = self.rows.slice(begin, end - begin).to_pylist()
        if rows and rows[0]["fails"] > attempt:
            return [{"n": n, "batch": rows[0]["batch"], "pos": None, "track": None, "available": None, "error": "UNAVAILABLE"}]
        return [r | {"error": None} for r in rows]


@dataclass
class Stretch(InputPartition):
    """The requests of one station in a micro-batch."""

    station: str


class RadioReader(DataSourceStreamReader):
    def __init__(self, service: str, player: str, rules: Rules) -> None:
        self.service, self.player, self.rules = service, player, rules

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The stretch that the player has committed as the next, or the last, of each station."""
        held = committed(self.player)
        rows = [] if held is None else held.to_table(columns=["station", "turn"], filter=ds.field("part") == "control").to_pylist()
        return {r["station"]: r["turn"] for r in sorted(rows, key=lambda r: r["station"])}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return [Stretch(s) for s, turn in sorted(end.items()) if turn > start.get(s, -1)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        """Answers by ``ask``, the number of the request in the stretch.

        Where this begins is the player's last version. The player commits what it got on the version before the
        read, so if another writer has come between, the commit is refused and the micro-batch runs again.
        """
        name = partition.station
        held = committed(self.player).to_table(filter=(ds.field("station") == name) & (ds.field("part") != "out")).to_pylist()
        station = Station(self.rules, [r for r in held if r["part"] == "queue"], next(r for r in held if r["part"] == "control"))
        service, ask, rows, going = Service(self.service, name), 0, 0, True
        while going and rows < self.rules.most:
            answer = service.answer(station.previous, station.attempt)
            for r in answer:
                yield name, ask, r["n"], r["batch"], r["pos"], r["track"], r["available"], r["error"]
            going, ask, rows = station.hear(answer), ask + 1, rows + len(answer)


class RadioSource(DataSource):
    """``spark.readStream.format("radio")`` with the options ``service`` and ``player``, and the player's ``Rules`` by their names.

    ``service`` is a Parquet folder partitioned by station, with (n, batch, pos, track, available, fails): batches in
    order, and how often a batch fails before it is given. A batch that fails comes as one row with ``error``.
    """

    @classmethod
    def name(cls) -> str:
        return "radio"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> RadioReader:
        return RadioReader(self.options["service"], self.options["player"], Rules(**{f.name: int(self.options.get(f.name, f.default)) for f in fields(Rules)}))
