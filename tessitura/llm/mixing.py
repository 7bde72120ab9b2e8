"""Mixing sources to target weights by thresholds on hashes, found in nested histograms.

One pass over the texts writes a narrow table of sizes and hashes. Sizes are summed by source and hash
bucket; the bucket in which a source's budget ends is the only one that is cut finer, so no document is
sorted and none but the boundary's is looked at twice. The mix is then a filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, small, staged

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"
HASH_BITS, LEVEL_BITS = 60, 10
TOP = (1 << HASH_BITS) - 1


def word_count(text: Column) -> Column:
    """Words between ASCII white space; a null text has none. No array of words is made."""
    bare = F.ltrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.length(F.regexp_replace(bare, WORD, "x")).cast("long")


def place(doc_id: Column, text: Column, seed: int) -> Column:
    """A row's place between 0 and 2^60: a hash of seed, doc_id and text."""
    own = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(own.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Sources (key, source_size) with ``weight``, ``target`` and ``whole`` (the target's whole words).

    Weights repeat in the order of keys. Together the targets are the sum of all sizes; none is above ``most``
    times its source's size, what is above is shared again by weight. Each turn is one aggregate of the small table.
    """
    cycle = F.array(*map(F.lit, weights))
    ranked = staged(numbered(sources, "key").withColumn("weight", F.element_at(cycle, (F.col("number") % len(weights) + 1).cast("int"))), "mix-weights")
    total, shares, count = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0)), F.count(F.lit(1))).first()
    rest, capped = total, 0
    above = F.lit(False)
    while count:
        wide = lambda c: c.cast("decimal(19,0)")
        above = wide(F.col("weight")) * wide(F.lit(rest)) > wide(F.col("source_size")) * wide(F.lit(most * shares))
        now, size, weight = ranked.where(above).agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if now == capped:
            break
        capped, rest = now, total - most * size
        shares = ranked.agg(F.sum("weight")).first()[0] - weight
    full = F.col("source_size") * most
    own = F.col("weight") * F.lit(rest).cast("long")
    return ranked.select(
        "key", "source_size", "weight",
        F.when(above, full.cast("double")).otherwise(own.cast("double") / F.lit(float(shares or 1))).alias("target"),
        F.when(above, full).otherwise(F.floor(own / F.lit(shares or 1))).cast("long").alias("whole"),
    )


def cuts(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Where each key's budget ends: ``key, low, most, high, left``.

    ``rows`` has (key, hash, size), ``budgets`` (key, low, most, left). Of the rows of a key with a hash above
    ``low`` and a size of at most ``most``, those up to ``high`` sum to at most the budget and ``left`` of it remains,
    and the rows of the next hash would not fit; its rows go together. ``edge`` is that hash, null if all rows fit.
    """
    open_ = staged(budgets.withColumn("prefix", F.lit(0).cast("long")), "mix-budgets")
    done: list[DataFrame] = []
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        held = rows.join(small(open_), "key").where((F.col("hash") > F.col("low")) & (F.col("size") <= F.col("most")) & (F.col("size") > 0))
        held = held.where(F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix"))
        sums = held.groupBy("key", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.min("hash").alias("first"), F.max("hash").alias("last"))
        so_far = F.sum("words").over(Window.partitionBy("key").orderBy("bucket"))
        over = sums.withColumn("so_far", so_far).join(small(open_), "key").where(F.col("so_far") > F.col("left"))
        edge = over.groupBy("key").agg(F.min_by(F.struct("bucket", "first", "last", (F.col("so_far") - F.col("words")).alias("below")), "bucket").alias("e"))
        fits = held.groupBy("key").agg(F.sum("size").alias("all"))
        found = staged(open_.join(edge, "key", "left").join(fits, "key", "left").select("key", "low", "most", "left", "e", "all"), "mix-level")
        inside = F.col("e").isNotNull()
        single = F.col("e.first") == F.col("e.last")
        left = F.when(inside, F.col("left") - F.col("e.below")).otherwise(F.col("left") - F.coalesce("all", F.lit(0)))
        closed = found.where(~inside | single)
        done.append(closed.select("key", "low", "most", F.when(inside, F.col("e.first") - 1).otherwise(TOP).alias("high"), left.alias("left"), F.col("e.first").alias("edge")))
        open_ = staged(found.where(inside & ~single).select("key", "low", "most", left.alias("left"), F.col("e.bucket").alias("prefix")), "mix-budgets")
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 12, rounds: int = 3) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs`` (doc_id, text, source).

    A source takes all its documents as often as its target holds its size, and once more those below a
    threshold of their hash. What then remains is less than the next document; in ``rounds - 1`` further
    rounds the documents above the threshold that are small enough share it in the same way.

    A null text is empty and has size 0, as a text of white space has; such rows take 0. A null source is a
    source of its own, after all others; rows without doc_id count like any. Rows that share doc_id and text
    share a hash and are taken together. An empty table gives no rows; other columns of ``docs`` are not looked at.
    """
    key = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    rows = staged(docs.select("doc_id", key.alias("key"), word_count(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text"), seed).alias("hash")), "mix-rows")
    wanted = targets(rows.groupBy("key").agg(F.sum("size").alias("source_size")), weights, most)
    repeats = F.when(F.col("source_size") > 0, F.expr("whole div source_size")).otherwise(0)
    plan = staged(wanted.withColumn("repeats", repeats.cast("long")), "mix-targets")
    open_ = plan.select("key", F.lit(-1).cast("long").alias("low"), F.lit(TOP).alias("most"), (F.col("whole") - F.col("repeats") * F.col("source_size")).alias("left")).where("left > 0")
    found = []
    for _ in range(rounds):
        cut = staged(cuts(rows, open_), "mix-cut")
        found.append(cut.select("key", F.struct("low", "high", "most").alias("range")))
        open_ = cut.where("edge IS NOT NULL AND left > 0").select("key", F.col("edge").alias("low"), F.col("left").alias("most"), "left")
    ranges = reduce(DataFrame.unionByName, found).groupBy("key").agg(F.collect_list("range").alias("ranges"))
    plan = staged(plan.join(ranges, "key", "left"), "mix-plan")
    once_more = F.exists("ranges", lambda r: (F.col("hash") > r["low"]) & (F.col("hash") <= r["high"]) & (F.col("size") <= r["most"]))
    taken = F.col("size") * (F.col("repeats") + F.coalesce(once_more, F.lit(False)).cast("long"))
    return rows.join(small(plan), "key").select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixing_sql(seed: int = 12, rounds: int = 3) -> str:
    """DuckDB SQL for :func:`mixed`: prefix sums by hash instead of histograms."""
    fill = ""
    for n in range(rounds):
        before = "SELECT source, -1::BIGINT AS low, 1152921504606846975 AS most, whole - repeats * source_size AS budget FROM plan" if not n else f"SELECT source, edge AS low, remains AS most, remains AS budget FROM e{n - 1} WHERE edge IS NOT NULL AND remains > 0"
        fill += f""",
        b{n} AS ({before}),
        p{n} AS (SELECT d.source, d.hash, b.low, b.most, b.budget, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash) AS so_far FROM d JOIN b{n} b ON d.source IS NOT DISTINCT FROM b.source AND d.hash > b.low AND d.size BETWEEN 1 AND b.most),
        e{n} AS (SELECT source, any_value(low) AS low, any_value(most) AS most, min(hash) FILTER (so_far > budget) AS edge, CAST(any_value(budget) - coalesce(max(so_far) FILTER (so_far <= budget), 0) AS BIGINT) AS remains FROM p{n} GROUP BY source)"""
    more = " OR ".join(f"coalesce(d.hash > e{n}.low AND d.size <= e{n}.most AND (e{n}.edge IS NULL OR d.hash < e{n}.edge), false)" for n in range(rounds))
    joins = " ".join(f"LEFT JOIN e{n} ON d.source IS NOT DISTINCT FROM e{n}.source" for n in range(rounds))
    return rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
          CAST('0x' || md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')))[1:15] AS BIGINT) AS hash FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
        o AS (SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0) AS BIGINT) AS rest, CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS shares,
          row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS n FROM s WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        k AS (SELECT rest, shares, n FROM o WHERE weight * rest <= 3 * source_size * shares ORDER BY n LIMIT 1),
        t AS (SELECT source, source_size, o.n < k.n AS capped, weight * k.rest AS own, k.shares FROM o, k),
        w AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(own AS DOUBLE) / shares END AS target, CASE WHEN capped THEN 3 * source_size ELSE own // shares END AS whole FROM t),
        plan AS (SELECT *, CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS repeats FROM w){fill}
        SELECT d.doc_id, d.size, p.source_size, p.target, d.size * (p.repeats + CASE WHEN {more} THEN 1 ELSE 0 END) AS taken
        FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source {joins}"""
