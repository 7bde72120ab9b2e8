"""Catalogue: entities, albums, history, stations, search sections, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.expr import col, contains_folded, nonempty
from tessitura.operators.library import has_more, page_of

#: The ids behind each station group, in order of precedence, and the order of groups.
KIDS = ("genre:children", "genre:childrens", "genre:kids", "genre:lullaby", "activity:children")
WORLD = ("genre:folk", "genre:world", "genre:ethnic")
GUITAR = ("genre:rock", "genre:metal", "genre:punk")
PIANO = ("genre:piano", "genre:classicalpiano")
MOON = ("activity:sleep", "mood:sleep", "activity:relax")
SPORT = ("activity:sport", "activity:running", "activity:workout")
GROUPS = ("KIDS", "WORLD", "GENRE", "MOOD", "ACTIVITY", "OTHER")


def classify(station: str | Column, parent: str | Column) -> Column:
    """(group, icon) of a station: children, world, guitar and piano match it or its parent, moon and sport it alone."""
    s, p = col(station), F.coalesce(col(parent), F.lit(""))
    either = lambda ids: s.isin(*ids) | p.isin(*ids)
    family = F.split_part(s, F.lit(":"), F.lit(1))
    pair = lambda group, icon: F.struct((F.lit(group) if isinstance(group, str) else group).alias("group"), F.lit(icon).alias("icon"))
    return (
        F.when(either(KIDS), pair("KIDS", "children"))
        .when(either(WORLD), pair("WORLD", "world"))
        .when(either(GUITAR), pair("GENRE", "guitar"))
        .when(either(PIANO), pair("GENRE", "piano"))
        .when(s.isin(*MOON), pair(F.when(family == "activity", "ACTIVITY").otherwise("MOOD"), "moon"))
        .when(s.isin(*SPORT), pair("ACTIVITY", "sport"))
        .when(family == "genre", pair("GENRE", "music"))
        .when(family == "mood", pair("MOOD", "mood"))
        .when(family == "activity", pair("ACTIVITY", "activity"))
        .otherwise(pair("OTHER", "music"))
    )


def station_rows(stations: DataFrame) -> DataFrame:
    """Stations with group and icon; a missing parent is empty."""
    return stations.select("*", classify("id", "parent_id").alias("c")).select("id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "title", "pos", "c.group", "c.icon")


def station_search(stations: DataFrame, query: str) -> DataFrame:
    """Stations whose title has the query in it, over the whole catalogue: pins and hidden ones have no say."""
    return station_rows(stations).where(contains_folded("title", query))


def with_every(accounts: DataFrame, catalogue: DataFrame, broadcast_rows: int = 50_000, part_rows: int = 10_000) -> DataFrame:
    """Each account with each row of a catalogue (id, ...).

    The catalogue is dealt in parts of about ``part_rows`` by id, and accounts meet the parts by number, so no task
    has to hold the whole of it; one of at most ``broadcast_rows`` short rows travels to the accounts.
    """
    size = catalogue.count()
    parts = max(1, -(-size // part_rows))
    dealt = catalogue.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    return accounts.withColumn("part", numbers).join(F.broadcast(dealt) if size <= broadcast_rows else dealt, "part").drop("part")


def station_groups(stations: DataFrame, pins: DataFrame, hidden: DataFrame, recent: DataFrame, most_recent: int = 8) -> DataFrame:
    """``account, group_ord, group, rank, id``: pinned stations, recent ones, then all others by group.

    ``pins(account, id, pos)``, ``hidden(account, id)``, ``recent(account, id, last, count)``. Hidden
    stations leave the first two groups only; recent ones beyond ``most_recent`` stay in their groups.
    Of stations with one id the last row counts. Accounts are those that ``recent`` or ``pins`` name.
    """
    rows = station_rows(stations)
    last = Window.partitionBy("id").orderBy(F.desc("pos"))
    rows = rows.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
    accounts = recent.select("account").union(pins.select("account")).distinct()
    # Every account sees the whole catalogue: that is the result's size.
    every = with_every(accounts, rows)
    hide = hidden.select("account", "id", F.lit(True).alias("hide")).distinct()
    facts = (
        every.join(pins.select("account", "id", F.col("pos").alias("pin")), ["account", "id"], "left")
        .join(hide, ["account", "id"], "left")
        .join(recent, ["account", "id"], "left")
    )
    shown = F.col("hide").isNull()
    pinned = F.col("pin").isNotNull() & shown
    candidate = F.col("last").isNotNull() & shown & ~pinned
    by_recency = Window.partitionBy("account", candidate).orderBy(F.desc("last"), F.desc("count"), "pos")
    recent_rank = F.when(candidate, F.row_number().over(by_recency))
    group_of = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("group")) + 1
    top = facts.withColumn("recent_rank", recent_rank)
    is_top = F.col("recent_rank") <= most_recent
    placed = top.select(
        "account", "id",
        F.when(pinned, 0).when(is_top, 1).otherwise(group_of).cast("int").alias("group_ord"),
        F.when(pinned, "PINNED").when(is_top, "RECENT").otherwise(F.col("group")).alias("group"),
        F.when(pinned, F.col("pin")).when(is_top, F.col("recent_rank")).otherwise(F.col("pos")).cast("long").alias("at"),
    )
    order = Window.partitionBy("account", "group_ord").orderBy("at", "id")
    return placed.select("account", "group_ord", "group", F.row_number().over(order).alias("rank"), "id")


def entity_rows(artists: DataFrame, albums: DataFrame) -> DataFrame:
    """Artists (id, name, genre) and albums (id, title, artist, year) as rows of one shape."""
    a = artists.select(F.col("id").cast("string").alias("id"), F.lit("artist").alias("kind"), nonempty("name", "UNKNOWN").alias("title"), F.coalesce("genre", F.lit("")).alias("detail"), F.lit("").alias("year"))
    b = albums.select(F.col("id").cast("string").alias("id"), F.lit("album").alias("kind"), nonempty("title", "UNTITLED").alias("title"), F.coalesce("artist", F.lit("")).alias("detail"), F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"))
    return a.unionByName(b).select("*", F.lit(0.0).alias("duration"), F.lit(True).alias("available"))


def search_sections(best: DataFrame, sections: list[tuple[str, DataFrame]], most: int = 6) -> DataFrame:
    """The best result, then up to ``most`` rows per section in the given order; a row may stand in several.

    Inputs have (kind, id, title, pos).
    """
    out = best.select(F.lit(0).alias("section_ord"), F.lit("BEST").alias("section"), "kind", "id", "title", F.lit(1).alias("rank"))
    for n, (name, rows) in enumerate(sections, 1):
        ranked = rows.select(F.lit(n).alias("section_ord"), F.lit(name).alias("section"), "kind", "id", "title", F.row_number().over(Window.partitionBy("kind").orderBy("pos", "id")).alias("rank"))
        out = out.unionByName(ranked.where(F.col("rank") <= most))
    return out


def album_flatten(albums: DataFrame) -> DataFrame:
    """Albums (album_id, volumes array<array<track>>) as rows: disc and position from one, a section label if there are several discs."""
    discs = albums.select("album_id", F.size("volumes").alias("n"), F.posexplode("volumes").alias("d", "tracks"))
    rows = discs.select("album_id", "n", (F.col("d") + 1).alias("disc"), F.posexplode("tracks").alias("p", "track"))
    position = F.col("p") + 1
    return rows.select(
        "album_id", "disc", position.alias("position"), F.col("track.id").alias("id"),
        F.when(F.col("n") > 1, F.concat(F.lit("DISC "), F.col("disc").cast("string"))).otherwise("").alias("section"),
        F.concat_ws(":", F.col("disc").cast("string"), position.cast("string"), F.col("track.id")).alias("key"),
    )


def history_flatten(tabs: DataFrame) -> DataFrame:
    """Tabs (account, tabs array<(date, items array<(tracks array<(type, id, album_id, title)>)>)>) as rows in order.

    Entries that are no tracks, or that have neither metadata nor an id, go; an entry with an id alone is a placeholder.
    """
    days = tabs.select("account", F.posexplode("tabs").alias("day", "tab"))
    items = days.select("account", "day", F.col("tab.date").alias("date"), F.posexplode("tab.items").alias("item", "i"))
    found = items.select("account", "day", "date", "item", F.posexplode("i.tracks").alias("n", "t"))
    kept = found.where((F.col("t.type") == "track") & (F.col("t.title").isNotNull() | F.col("t.id").isNotNull()))
    return kept.select("account", "day", "date", "item", "n", F.col("t.id").alias("id"), F.coalesce("t.title", F.concat(F.lit("TRACK "), F.col("t.id"))).alias("title"), F.col("t.title").isNotNull().alias("available"))


def grid_lines(rows: DataFrame, group: str, order: list[str], width: int) -> DataFrame:
    """Rows of each group in lines of ``width``: ``group, line, ids``."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    placed = rows.select(F.col(group), n.alias("n"), "id").withColumn("line", F.floor(F.col("n") / width))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"])
    return placed.groupBy(group, "line").agg(F.array_join(ids, ",").alias("ids"))


def grid_headings(rows: DataFrame, group: str, order: list[str], width: int, collapsed: DataFrame, filtering: bool = False) -> DataFrame:
    """The lines of :func:`grid_lines` under a heading (line -1, no ids) per group; a collapsed group (group) keeps the heading alone unless filtering."""
    lines = grid_lines(rows, group, order, width)
    if not filtering:
        lines = lines.join(collapsed.select(F.col(group)).distinct(), group, "left_anti")
    headings = rows.select(group).distinct().select(group, F.lit(-1).cast("long").alias("line"), F.lit("").alias("ids"))
    return headings.unionByName(lines)


def service_page(rows: DataFrame, key: str, page: int, size: int, known_total: bool = True) -> DataFrame:
    """A page of ``size`` rows of every ``key`` by ``pos``, with ``total`` (-1 if the service does not tell) and ``more``.

    Tracks of an artist come in pages of 50, an artist's albums in pages of 20, search results in the service's size.
    """
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("total")) if known_total else rows.select(key).distinct().withColumn("total", F.lit(-1).cast("long"))
    return page_of(rows, page, size).join(counted, key).withColumn("more", has_more(page, size, F.col("total")))


def section_breaks(rows: DataFrame, partition: str, order: list[str], section: str) -> DataFrame:
    """Rows with ``starts_section``: a non-empty section that differs from the row before."""
    before = F.lag(section).over(Window.partitionBy(partition).orderBy(*order))
    return rows.withColumn("starts_section", (F.col(section) != "") & ~F.col(section).eqNullSafe(before))


def header_text(*parts: str | Column) -> Column:
    """The parts that are not empty, joined by a middle dot."""
    return F.concat_ws(" · ", *[F.nullif(col(p), F.lit("")) for p in parts])
