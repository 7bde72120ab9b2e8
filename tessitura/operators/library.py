"""Library: likes in pages, merges of changes, overlays, ordered unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.expr import base_id, is_entity_id, is_track_id


def page_of(rows: DataFrame, page: int, size: int = 50, pos: str = "pos") -> DataFrame:
    """One page of rows that have a position; no sort and no offset."""
    return rows.where((F.col(pos) >= page * size) & (F.col(pos) < (page + 1) * size))


def has_more(page: int | Column, size: int, total: str | Column) -> Column:
    """Whether rows follow a page; an unknown total (-1) has none."""
    return (F.lit(page) + 1) * size < total if isinstance(page, int) else (page + 1) * size < total


def with_metadata(ids: DataFrame, tracks: DataFrame) -> DataFrame:
    """Ids (account, pos, full_id) with their tracks' metadata; an id without any becomes an unavailable placeholder.

    A left equi join on the base id; positions are kept, so order needs no sort.
    """
    known = tracks.select(F.col("id").alias("__id"), "title", "artist", "duration", "available")
    return ids.withColumn("id", base_id("full_id")).join(known, F.col("id") == F.col("__id"), "left").select(
        "account", "pos", "full_id", "id",
        F.coalesce("title", F.concat(F.lit("TRACK "), F.col("id"))).alias("title"),
        F.coalesce("artist", F.lit("")).alias("artist"),
        F.coalesce("duration", F.lit(0.0)).alias("duration"),
        F.coalesce("available", F.lit(False)).alias("available"),
    )


def likes_page(likes: DataFrame, tracks: DataFrame, page: int, size: int = 50) -> DataFrame:
    """A page of every account's likes in like order, with placeholders for unknown tracks."""
    return with_metadata(page_of(likes, page, size), tracks)


def like_totals(likes: DataFrame, page: int, size: int = 50) -> DataFrame:
    """``account, total, loaded, more`` for a page."""
    loaded = F.count_if((F.col("pos") >= page * size) & (F.col("pos") < (page + 1) * size))
    return likes.groupBy("account").agg(F.count(F.lit(1)).alias("total"), loaded.alias("loaded")).withColumn("more", has_more(page, size, F.col("total")))


def valid_changes(changes: DataFrame) -> DataFrame:
    """Changes with a valid track id and, if given, a valid album id."""
    album = F.coalesce("album_id", F.lit(""))
    return changes.where(is_track_id("track_id") & ((album == "") | is_entity_id(album)))


def merged_places(likes: DataFrame, changes: DataFrame, parts: dict[str, Column] | None = None) -> DataFrame:
    """Likes (account, place, full_id) after confirmed changes, in places that order them; no like that stays is given another.

    ``changes`` has (account, seq, track_id, album_id, liked, status). Only the last confirmed change
    of a base id counts, with one exception that order demands: a removal before an addition moves
    the like to the front. Adding what is there, or removing what is not, changes nothing. New
    likes stand before all others, the newest first, at ``-1 - seq``, under the given full id, else base:album,
    else the base. Equal to applying the changes one by one. Likes and changes are shuffled once, together, by account
    and base; with ``parts``, columns made of those two, by these, which then stand before the result's columns and in its order.
    """
    known = valid_changes(changes).where("status = 'confirmed' AND account IS NOT NULL").withColumn("base", base_id("track_id"))
    own = F.when(F.contains("track_id", F.lit(":")), F.col("track_id")).when(F.coalesce("album_id", F.lit("")) != "", F.concat_ws(":", "base", "album_id")).otherwise(F.col("base"))
    new = known.select("account", "base", F.col("seq").cast("long").alias("seq"), "liked", own.alias("full_id"), F.lit(None).cast("long").alias("place"), F.lit(False).alias("there"))
    old = likes.select("account", base_id("full_id").alias("base"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("boolean").alias("liked"), "full_id", F.col("place").cast("long").alias("place"), F.lit(True).alias("there"))
    rows, names = old.unionByName(new), list(parts or {})
    if parts:
        rows = rows.withColumns(parts).repartition(*names)
    of_base = Window.partitionBy(*names, "account", "base").orderBy(F.desc("there"), "seq")
    whole = of_base.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.last("liked", ignorenulls=True).over(of_base.rowsBetween(Window.unboundedPreceding, -1))
    facts = rows.withColumns({
        # An addition takes effect when the base is absent then: at the start if it was no like, or after a removal.
        "added": ~F.col("there") & F.col("liked") & ~F.coalesce(before, F.first("there").over(whole)),
        "removed": F.coalesce(F.max(~F.col("liked")).over(whole), F.lit(False)),
        "wanted": F.last("liked").over(whole),
        "number": F.row_number().over(of_base),
    })
    newest = facts.withColumn("newest", F.max(F.when(F.col("added"), F.col("number"))).over(whole))
    # What was there stays unless some change removed it; what came back is a new like.
    kept = newest.where("there AND NOT removed OR added AND wanted AND number = newest")
    return kept.select(*names, "account", F.coalesce("place", -1 - F.col("seq")).alias("place"), "full_id")


def placed_likes(likes: DataFrame) -> DataFrame:
    """``account, pos, full_id`` of likes (account, place, full_id)."""
    order = Window.partitionBy("account").orderBy("place", "full_id")
    return likes.select("account", (F.row_number().over(order) - 1).alias("pos"), "full_id")


def likes_merge(likes: DataFrame, changes: DataFrame) -> DataFrame:
    """Likes (account, pos, full_id) after confirmed changes, numbered anew: :func:`merged_places`."""
    return placed_likes(merged_places(likes.withColumnRenamed("pos", "place"), changes))


def likes_overlay(likes: DataFrame, changes: DataFrame) -> DataFrame:
    """Liked base ids as shown while changes run: a pending change wins over the snapshot, a failed one never was.

    Returns ``account, base, pending`` for what is liked.
    """
    base = likes.select("account", base_id("full_id").alias("base")).distinct().withColumn("present", F.lit(True))
    alive = valid_changes(changes).where("status <> 'failed'").withColumn("base", base_id("track_id"))
    wanted = alive.groupBy("account", "base").agg(F.max_by(F.struct("liked", (F.col("status") == "pending").alias("pending")), "seq").alias("w"))
    both = base.join(wanted, ["account", "base"], "full_outer")
    liked = F.coalesce(F.col("w.liked"), F.col("present"), F.lit(False))
    return both.where(liked).select("account", "base", F.coalesce(F.col("w.pending"), F.lit(False)).alias("pending"))


def shown_likes(log: DataFrame) -> DataFrame:
    """What is shown after each step of a log (account, base, seq, step, liked): ``account, base, seq, shown``.

    A change shows as soon as it begins (``begin``); one that ends ``failed`` rolls back to what was before it,
    which is the opposite; ``ok`` leaves it.
    """
    order = Window.partitionBy("account", "base").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.last(F.when(F.col("step") == "begin", F.col("liked")), ignorenulls=True).over(order)
    return log.select("account", "base", "seq", F.when(F.col("step") == "failed", ~wanted).otherwise(wanted).alias("shown"))


def like_refreshes(log: DataFrame) -> DataFrame:
    """``account, seq``: the steps of a log (account, seq, step) after which the first page is loaded anew.

    That is when no change is pending any more and one was ``ok`` since the last time none was: once per burst.
    """
    order = Window.partitionBy("account").orderBy("seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    pending = F.sum(F.when(F.col("step") == "begin", 1).otherwise(-1)).over(so_far)
    idle = log.select("account", "seq", "step", ((F.col("step") != "begin") & (pending <= 0)).alias("idle"))
    before = F.coalesce(F.sum(F.col("idle").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bursts = idle.withColumn("burst", before)
    changed = F.max(F.col("step") == "ok").over(Window.partitionBy("account", "burst").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return bursts.withColumn("changed", changed).where("idle AND changed").select("account", "seq")


def first_of(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in a total order."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def page_merge(pages: DataFrame) -> DataFrame:
    """Pages (list_id, page, pos, key, kind, id, section) appended without repeats: the first of a key stays.

    The key is ``key`` if there is one, else kind, id and section. Page zero starts the list anew, so
    rows of a version before the last page zero are not given.
    """
    own = F.coalesce("key", F.concat_ws("|", F.lit("row"), "kind", "id", "section"))
    kept = first_of(pages.withColumn("merge_key", own), ["list_id", "merge_key"], ["page", "pos"])
    order = Window.partitionBy("list_id").orderBy("page", "pos")
    return kept.select("list_id", "page", "pos", "kind", "id", "section", (F.row_number().over(order) - 1).alias("at"))


def toggles(actions: DataFrame) -> DataFrame:
    """Members after toggles (account, item, seq): those toggled an odd number of times, in the order of their last toggle."""
    odd = actions.groupBy("account", "item").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last")).where("n % 2 = 1")
    order = Window.partitionBy("account").orderBy("last", "item")
    return odd.select("account", "item", (F.row_number().over(order) - 1).alias("pos"))


def ordered_distinct(rows: DataFrame, key: list[str], value: str, pos: str) -> DataFrame:
    """Each value once, where it came first: minima, combined before the shuffle."""
    return rows.groupBy(*key, value).agg(F.min(pos).alias(pos))
