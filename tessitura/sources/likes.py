"""Likes as a versioned store: a commit rewrites only the buckets of the accounts it changes.

Every like keeps the place it was given; new ones get places in front of all others, so nothing is numbered anew.
A version is a list of folders, one per bucket of accounts, and never changes: readers see one version, and an
earlier one can be made the last again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators.library import merged_places, placed_likes, valid_changes
from tessitura.sources import versions
from tessitura.sources.versions import StaleVersion

DDL = "account long, place long, full_id string"


class LikeStore:
    """Likes under ``path``, dealt over ``buckets`` by account; the number of buckets is that of the store's first version."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _manifest(self, version: int | None = None) -> tuple[int, dict]:
        found = versions.pointer(self.spark, self.path, version)
        if found is None:
            raise ValueError(f"{self.path} has no version {'' if version is None else version}")
        return found

    def _bucket(self, count: int):
        return F.pmod(F.xxhash64(F.col("account").cast("long")), F.lit(count)).cast("int")

    def _write(self, rows: DataFrame, count: int) -> dict[str, str]:
        """Rows as a new folder; the folder of each bucket that has any. A bucket is dealt over four files, so a hot account is not one task; rows with a ``bucket`` are dealt already."""
        name = f"data-{uuid.uuid4().hex}"
        if "bucket" not in rows.columns:
            rows = rows.withColumn("bucket", self._bucket(count)).repartition("bucket", F.pmod(F.xxhash64("full_id"), F.lit(4)))
        rows.select("account", F.col("place").cast("long").alias("place"), "full_id", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        fs, folder = versions.hadoop_path(self.spark, f"{self.path}/{name}")
        found = [s.getPath().getName() for s in fs.listStatus(folder)]
        return {x.removeprefix("bucket="): f"{name}/{x}" for x in found if x.startswith("bucket=")}

    def start(self, likes: DataFrame) -> int:
        """The first version, of likes (account, pos, full_id); StaleVersion if the store has one."""
        folders = self._write(likes.withColumnRenamed("pos", "place"), self.buckets)
        return versions.commit(self.spark, self.path, {"count": self.buckets, "last_seq": {}, "folders": folders, "changed": sorted(folders)}, -1)

    def _rows(self, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
        folders = [f for b, f in manifest["folders"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(DDL).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], DDL)

    def read(self, version: int | None = None) -> DataFrame:
        """Likes (account, place, full_id) of a version, the last one if none is named."""
        return self._rows(self._manifest(version)[1])

    def likes(self, version: int | None = None) -> DataFrame:
        """Likes (account, pos, full_id) of a version."""
        return placed_likes(self.read(version))

    def merge(self, changes: DataFrame) -> int:
        """Commit confirmed changes (account, seq, track_id, album_id, liked, status); the new version's number.

        Their ``seq`` follow those of earlier commits to the same buckets. What another writer commits meanwhile stays: other buckets are
        taken over as they are, and for the same ones the merge is done again on top of it. Invalid, pending and
        failed changes count for nothing; if no change counts, the last version stays.
        """
        known = valid_changes(changes).where("status = 'confirmed'")
        version, manifest = self._manifest()
        count = manifest["count"]
        of_bucket = known.groupBy(self._bucket(count).alias("bucket")).agg(F.min("seq").alias("low"), F.max("seq").alias("high")).collect()  # at most a row per bucket
        seen = [r for r in of_bucket if r["low"] is not None]
        if not seen:
            return version
        low, high = min(r["low"] for r in seen), max(r["high"] for r in seen)
        touched = sorted(str(r["bucket"]) for r in of_bucket)
        parts = {"bucket": self._bucket(count), "part": F.pmod(F.xxhash64("base"), F.lit(4)).cast("int")}
        folders: dict[str, str] | None = None
        while True:
            last_seq = max((manifest["last_seq"].get(b, -1) for b in touched), default=-1)
            if low <= last_seq:
                raise StaleVersion(f"changes from {low} on come after {last_seq} was committed")
            if folders is None:
                folders = self._write(merged_places(self._rows(manifest, touched), known, parts), count)
            kept = {b: f for b, f in manifest["folders"].items() if b not in touched}
            try:
                return versions.commit(self.spark, self.path, {"count": count, "last_seq": manifest["last_seq"] | dict.fromkeys(touched, int(high)), "folders": kept | folders, "changed": touched}, version)
            except StaleVersion:
                last, (version, manifest) = version, self._manifest()
                between = [self._manifest(v)[1]["changed"] for v in range(last + 1, version + 1)]
                if any(set(touched) & set(b) for b in between):
                    folders = None

    def roll_back(self, version: int) -> int:
        """Make an earlier version the last again, as a version of its own; nothing is rewritten. Changes after it may then be committed anew."""
        last, now = self._manifest()
        old = self._manifest(version)[1]
        differs = sorted(b for b in {*old["folders"], *now["folders"]} if old["folders"].get(b) != now["folders"].get(b))
        return versions.commit(self.spark, self.path, old | {"changed": differs}, last)
