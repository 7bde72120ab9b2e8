"""Relations of the music domain: from the service's records, and stand-ins from the fixture tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions.expr import account_key
from tessitura.sources import versions

ARTISTS = "array<struct<id:string,title:string>>"
TRACK_DDL = f"id string, title string, artist string, artists {ARTISTS}, album_id string, album_title string, cover string, duration double, available boolean"
EVENT_DDL = "play string, account long, id string, at timestamp, source string, seconds double, cause string"

#: What an event of the fixture table means for a play.
CAUSES = {"error": "manual-skip", "click": "finished", "purchase": "finished", "view": "source-change", "signup": "stop"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per file of JSON: its object in the columns of ``schema``; a corrupt file or no object gives nulls."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("o")).select("o.*")


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Replace what ``path`` holds by the rows as JSON; :func:`read_json` gives them.

    They are a new version in the sense of :mod:`~tessitura.sources.versions`: readers get the old rows or the new
    ones at any moment, also after a job that failed. The folder is for its owner alone (0700). The version's number.
    """
    return versions.replace(df.sparkSession, path, (df.write.partitionBy(*partition_by) if partition_by else df.write).json)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that :func:`write_json` put there last; none if there are none."""
    folder = versions.current(spark, path)
    return spark.createDataFrame([], schema) if folder is None else spark.read.schema(schema).json(folder)


def write_by_account(df: DataFrame, path: str, account: str = "account") -> None:
    """Rows as Parquet in a folder per account, named by :func:`~tessitura.functions.expr.account_key`; only folders of accounts in ``df`` are replaced."""
    keyed = df.withColumn("account_key", account_key(account))
    keyed.repartition("account_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("account_key").parquet(path)


def data_path(spark: SparkSession, kind: str, name: str, default: str) -> str:
    """Where data of a kind (config, state, cache) lie: the environment's ``TESSITURA_<KIND>``, else the session's ``tessitura.path.<kind>``, else ``default``."""
    base = os.environ.get(f"TESSITURA_{kind.upper()}") or spark.conf.get(f"tessitura.path.{kind}", default)
    return f"{base.rstrip('/')}/{name}"


def artist_links(artists: Column, unknown: str = "UNKNOWN") -> Column:
    """Artists with a usable id (not null, empty or 0) as (id, title)."""
    usable = F.filter(artists, lambda a: a["id"].isNotNull() & ~a["id"].cast("string").isin("", "0"))
    return F.transform(usable, lambda a: F.struct(a["id"].cast("string").alias("id"), F.coalesce(F.nullif(a["name"], F.lit("")), F.lit(unknown)).alias("title")))


def track_model(raw: DataFrame) -> DataFrame:
    """Service tracks (id, title, artists, albums, duration_ms, available, cover) as tracks."""
    names = F.filter(F.transform("artists", lambda a: a["name"]), lambda n: n.isNotNull() & (n != ""))
    album = F.get("albums", F.lit(0))
    return raw.select(
        F.col("id").cast("string").alias("id"),
        F.coalesce(F.nullif("title", F.lit("")), F.lit("UNTITLED")).alias("title"),
        F.array_join(names, ", ").alias("artist"),
        artist_links(F.col("artists")).alias("artists"),
        F.coalesce(album["id"].cast("string"), F.lit("")).alias("album_id"),
        F.coalesce(album["title"], F.lit("")).alias("album_title"),
        F.coalesce("cover", F.lit("")).alias("cover"),
        (F.coalesce("duration_ms", F.lit(0)) / F.lit(1000.0)).alias("duration"),
        F.col("available").eqNullSafe(F.lit(True)).alias("available"),
    )


def track_rows(tracks: DataFrame, detail: Column | None = None) -> DataFrame:
    """Flat rows: the detail falls back to the artist."""
    own = F.lit("") if detail is None else detail
    return tracks.select("*", F.coalesce(F.nullif(own, F.lit("")), F.col("artist")).alias("detail"), F.lit("track").alias("kind"))


def raw_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's parts as records of the service."""
    p = table(spark, sf_dir, "part")
    brand = F.struct(F.col("p_brand").alias("id"), F.col("p_brand").alias("name"))
    kind = F.struct(F.col("p_type").alias("id"), F.col("p_type").alias("name"))
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_partkey") % 4 == 0, F.array(brand, kind)).otherwise(F.array(brand)).alias("artists"),
        F.array(F.struct(F.col("p_type").alias("id"), F.col("p_type").alias("title"))).alias("albums"),
        F.lit("").alias("cover"),
        (F.col("p_retailprice") * 1000).alias("duration_ms"),
        (F.col("p_size") % 10 != 0).alias("available"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_model(raw_tracks(spark, sf_dir))


def listening_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    cause = F.create_map(*[F.lit(x) for item in CAUSES.items() for x in item])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("play"),
        F.col("user_id").alias("account"),
        F.get_json_object("props", "$.k").alias("id"),
        F.col("ts").cast("timestamp").alias("at"),
        F.lit("fixture").alias("source"),
        F.col("value").alias("seconds"),
        F.try_element_at(cause, F.col("event_type")).alias("cause"),
        "event_id",
        "event_type",
    )


def rating_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, id, value (-2, -1, 1, or 0 to clear), at, event_id."""
    e = listening_events(spark, sf_dir)
    k = F.col("id").cast("int")
    value = (
        F.when((F.col("event_type") == "click") & (k % 5 == 0), 1)
        .when((F.col("event_type") == "view") & (k % 5 == 0), -1)
        .when((F.col("event_type") == "error") & (k % 7 == 0), -2)
        .when(F.col("event_type") == "signup", 0)
    )
    return e.select("account", "id", value.alias("value"), "at", "event_id").where("value IS NOT NULL")


def liked_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, id, pos: bought tracks, the last bought first."""
    from pyspark.sql import Window

    bought = listening_events(spark, sf_dir).where("event_type = 'purchase'").groupBy("account", "id").agg(F.max(F.struct("at", "event_id")).alias("last"))
    order = Window.partitionBy("account").orderBy(F.desc("last.at"), F.desc("last.event_id"))
    return bought.select("account", "id", (F.row_number().over(order) - 1).alias("pos"))


def like_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, pos, full_id: one like per track of an account's orders, the newest first."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    first = rows.groupBy(F.col("o_custkey").alias("account"), "l_partkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "l_suppkey")).alias("last"))
    order = Window.partitionBy("account").orderBy(F.desc("last.o_orderdate"), F.desc("last.o_orderkey"), "l_partkey")
    full = F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("last.l_suppkey").cast("string"))
    return first.select("account", (F.row_number().over(order) - 1).alias("pos"), full.alias("full_id"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent_id, title, pos: nations as stations of five families."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    family = F.element_at(F.array(*map(F.lit, ("genre", "mood", "activity", "genre", "other"))), F.col("n_regionkey") + 1)
    parent = F.element_at(F.array(*map(F.lit, ("genre:children", "genre:folk", "", "genre:rock", ""))), F.col("n_regionkey") + 1)
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        F.concat_ws(":", family, F.lower("n_name")).alias("id"),
        F.when(F.col("n_nationkey") % 2 == 0, parent).otherwise("").alias("parent_id"),
        F.initcap("n_name").alias("title"),
        F.col("n_nationkey").alias("pos"),
    )
