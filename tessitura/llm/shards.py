"""Immutable shards with size-tiered compaction and a versioned manifest.

A store is a folder with ``data/<run>/`` (Parquet shards that never change) and
``manifest/<version>.json`` (the runs of that version). An append writes its rows as one run of
small shards. Compaction merges ``fan_in`` runs of a size tier (each tier is ``fan_in`` times as
large as the one below) into one run of files of about ``target_bytes``. Every change is committed
by creating the manifest of the next version, whole and at once, which fails if that version exists: a hard
link on local files, a rename without overwriting on HDFS. Other stores promise neither to every writer and are
refused. Readers see one version whole. Every manifest names the one it follows, so a commit on a base that is no longer the
last is refused even where a vacuum has freed the number it would take. Old manifests and runs go by
age only, and a job that dies before its commit leaves files that no manifest names, until they are old.

Lists of shards are metadata and live in the driver; rows never do.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.sources.versions import put_once

from .exact_dedup import from_files


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fan_in: int = 4, smallest_bytes: int = 1 << 20) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.fan_in, self.smallest_bytes = target_bytes, fan_in, smallest_bytes
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("manifest"))

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    # Manifests

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifest"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """``version`` and ``runs``; version 0 is the empty store."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "runs": [], "schema": None}
        stream = self._fs.open(self._path(f"manifest/{version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: dict, runs: list[dict], schema: str) -> dict:
        """Make ``runs`` the version after ``base``; Conflict if ``base`` is not the last version any more."""
        new = {"version": base["version"] + 1, "id": uuid.uuid4().hex, "parent": base.get("id"), "runs": runs, "schema": schema}
        if max(self.versions(), default=0) != base["version"]:
            raise Conflict(f"version {base['version']} is not the last one")
        name = f"manifest/{new['version']:010d}.json"
        if not put_once(self.spark, f"{self.path}/{name}", json.dumps(new)):
            raise Conflict(f"version {new['version']} exists")
        final = self._path(name)
        # Others may have gone on, and a vacuum may have freed this number, between the look and the rename.
        later = [v for v in self.versions() if v > new["version"]]
        if later and (later[0] != new["version"] + 1 or self.manifest(later[0])["parent"] != new["id"]):
            self._fs.delete(final, False)
            raise Conflict(f"version {base['version']} is not the last one")
        return new

    # Runs

    def _write(self, df: DataFrame) -> dict:
        name = uuid.uuid4().hex
        df.write.option("compression", "zstd").parquet(f"{self.path}/data/{name}")
        files = [[s.getPath().getName(), s.getLen()] for s in self._fs.listStatus(self._path(f"data/{name}")) if s.getPath().getName().startswith("part-")]
        return {"run": name, "files": sorted(files), "bytes": sum(n for _, n in files)}

    def append(self, df: DataFrame) -> dict:
        """Write ``df`` as a run and commit it; all appends must have the same schema."""
        run = self._write(df)
        schema = df.schema.json()
        while True:
            base = self.manifest()
            if base["schema"] not in (None, schema):
                raise ValueError("the store has another schema")
            try:
                return self.commit(base, [*base["runs"], run], schema)
            except Conflict:
                continue

    def tier(self, run: dict) -> int:
        return max(0, math.floor(math.log(max(run["bytes"], 1) / self.smallest_bytes, self.fan_in) + 1e-9)) if run["bytes"] > self.smallest_bytes else 0

    def _mergeable(self, runs: list[dict]) -> list[dict] | None:
        """The oldest ``fan_in`` runs of the lowest tier that has as many; runs of target-sized files are done."""
        tiers: dict[int, list[dict]] = {}
        for run in runs:
            if len(run["files"]) > max(1, math.ceil(run["bytes"] / self.target_bytes)) or run["bytes"] < self.target_bytes / 2:
                tiers.setdefault(self.tier(run), []).append(run)
        for _, found in sorted(tiers.items()):
            if len(found) >= self.fan_in:
                return found[: self.fan_in]
        return None

    def _files(self, runs: list[dict]) -> list[str]:
        return [f"{self.path}/data/{r['run']}/{name}" for r in runs for name, _ in r["files"]]

    def _read(self, runs: list[dict], schema: str) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*self._files(runs))

    def merge(self, runs: list[dict]) -> dict:
        """Commit a version in which one new run stands for ``runs``. No shuffle: tasks read several shards each."""
        base = self.manifest()
        names = {r["run"] for r in runs}
        size = sum(r["bytes"] for r in runs)
        new = self._write(self._read(runs, base["schema"]).coalesce(max(1, math.ceil(size / self.target_bytes))))
        while True:
            now = self.manifest()
            if not names <= {r["run"] for r in now["runs"]}:
                raise Conflict("another writer has merged these runs")
            try:
                return self.commit(now, [*(r for r in now["runs"] if r["run"] not in names), new], now["schema"])
            except Conflict:
                continue

    def compact(self) -> dict:
        """Merge until no tier has ``fan_in`` runs. Runs that were merged stay for readers of older versions, until :meth:`vacuum`."""
        while (runs := self._mergeable(self.manifest()["runs"])) is not None:
            self.merge(runs)
        return self.manifest()

    def vacuum(self, older_than: float = 7 * 86_400) -> None:
        """Drop manifests that were followed by another one over ``older_than`` seconds ago, and runs as old that no manifest names.

        Readers of a version and writers of a run have as many seconds; the last manifest always stays.
        """
        before = (time.time() - older_than) * 1000
        written = {int(s.getPath().getName()[:-5]): s.getModificationTime() for s in self._fs.listStatus(self._path("manifest")) if s.getPath().getName().endswith(".json")}
        order = sorted(written)
        for version, after in zip(order, order[1:], strict=False):
            if written[after] <= before:
                self._fs.delete(self._path(f"manifest/{version:010d}.json"), False)
        named = {r["run"] for v in self.versions() for r in self.manifest(v)["runs"]}
        if self._fs.exists(self._path("data")):
            for run in self._fs.listStatus(self._path("data")):
                if run.getPath().getName() not in named and run.getModificationTime() <= before:
                    self._fs.delete(run.getPath(), True)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, with the shard each row lies in as ``_metadata.file_name``; None if it has no runs."""
        found = self.manifest(version)
        return self._read(found["runs"], found["schema"]) if self._files(found["runs"]) else None


def arrivals_of(docs: DataFrame, arrivals: int) -> list[DataFrame]:
    """The rows of ``docs`` as ``arrivals`` parts, dealt by the file they come from, or by file and row where there are fewer files.

    Filters and expressions of ``docs`` hold; Spark prunes files by their path, so that each is read
    by one part. What is no read of files is written to the shared folder first.
    """
    docs = from_files(docs)
    place = ["_metadata.file_path"] if len(docs.inputFiles()) >= arrivals else ["_metadata.file_path", "_metadata.row_index"]
    part = F.pmod(F.xxhash64(*place), F.lit(arrivals))
    return [docs.where(part == i) for i in range(arrivals)]


def sharded(docs: DataFrame, path: str, arrivals: int = 5, **options) -> ShardStore:
    """A store of ``docs``, appended in ``arrivals`` runs and compacted.

    Nulls, repeated rows and all columns are kept as they are; an empty table makes empty runs.
    """
    store = ShardStore(docs.sparkSession, path, **options)
    for part in arrivals_of(docs, arrivals):
        store.append(part)
        store.compact()
    return store
