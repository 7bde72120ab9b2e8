"""Audit of how sources differ in their terms: distances between all sources of a language, and each one's own terms.

Counts are sparse: a term that a source lacks has the source's baseline share, so a pair of sources is the distance
of two baselines times the number of terms, corrected for the terms that either has. The top terms of every source
are found by radix selection: histograms over digits of the value, then over bytes of the term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, small, staged

#: Bytes of terms stay, A to Z in lower case; all other ASCII parts terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
VALUE_BITS = 30
KEYS = ["lang", "source"]


def _counted(entries: int):
    """For ``mapInArrow``: (lang, source, text as bytes) to partial counts of terms, and a row without a term per group.

    A task holds at most ``entries`` counts and those of one slice of rows, then writes them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in counts.items():
                terms = [None, *n]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())], schema=COUNTS)
            counts.clear()

        for part in slices(batches, 256):
            for lang, source, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                terms = text.translate(TERM_BYTES).split()
                n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                n.update(terms)
                docs.update(set(terms))
            if sum(len(n) for n, _ in counts.values()) > entries:
                yield from flushed()
        yield from flushed()

    return run


def term_counts(docs: DataFrame, entries: int = 200_000) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term in each group; a row without term per group."""
    clean = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in KEYS), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    parts = clean.mapInArrow(_counted(entries), "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column, smooth: int = 5, unit: int = 10**9) -> Column:
    """``1 + floor(unit * (n + smooth) / (total + smooth * terms))``, exact."""
    up, down = (n + smooth).cast("decimal(19,0)") * F.lit(unit).cast("decimal(10,0)"), (total + smooth * terms).cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", up, down)


def top_terms(rows: DataFrame, most: int = 50, digit: int = 10) -> DataFrame:
    """The ``most`` rows of each group (lang, source, term, value) with the largest values, equal ones by the term's bytes.

    Level by level a histogram over the next digit tells in which digit's rows the last place lies: rows of better
    digits are in, rows of worse ones out, and only the rows of that digit go on. No group is sorted.
    """
    levels = [F.lit((1 << digit) - 1) - F.shiftright("value", shift).bitwiseAND((1 << digit) - 1) for shift in range(VALUE_BITS - digit, -1, -digit)]
    rest = staged(rows.withColumn("need", F.lit(most).cast("long")), "ranked-terms")
    found, at, width = [], 1, 2
    while True:
        if levels:
            key = F.lpad(F.hex(levels.pop(0)), 8, "0")
        else:
            key = F.hex(F.substring(F.col("term").cast("binary"), at, width))
            at, width = at + width, min(2 * width, 1 << 20)
        keyed = rest.withColumn("key", key)
        sums = keyed.groupBy(*KEYS, "key").agg(F.count(F.lit(1)).alias("rows"), F.first("need").alias("need"))
        so_far = sums.withColumn("so_far", F.sum("rows").over(Window.partitionBy(*KEYS).orderBy("key")))
        over = F.min(F.when(F.col("so_far") > F.col("need"), F.struct("key", (F.col("need") - F.col("so_far") + F.col("rows")).alias("left"))))
        edge = staged(so_far.groupBy(*KEYS).agg(over.alias("edge")), "rank-edges")
        placed = keyed.drop("need").join(small(edge), KEYS)
        found.append(placed.where(F.col("edge").isNull() | (F.col("key") < F.col("edge.key"))).select(*KEYS, "term", "value"))
        rest = staged(placed.where((F.col("key") == F.col("edge.key")) & (F.col("edge.left") > 0)).select(*rows.columns, F.col("edge.left").alias("need")), "ranked-terms")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, found)


def audited(docs: DataFrame, least_docs: int = 30, most: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs`` (text, lang, source), whose nulls are empty strings.

    Terms are runs of letters and of all that is not ASCII, A to Z in lower case; a language keeps those in at least
    ``least_docs`` of its documents. Part ``pair`` ranks each other source of the language by the summed distance of
    shares; part ``term`` the up to ``most`` terms of which a source has more than its language, by how much.

    Empty texts make a group without terms, which stands in pairs by its baseline; in a language without kept terms
    all pairs are at 0. Equal values rank by the item's UTF-8 bytes. Repeated rows count as often as they come; an
    empty table gives no rows; other columns are not looked at. The result has a row for each two sources of a language.
    """
    counts = staged(term_counts(docs), "term-counts")
    terms = counts.where("term IS NOT NULL")
    kept = staged(terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    entries = staged(terms.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "term-entries")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    sizes = entries.groupBy(*KEYS).agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = counts.where("term IS NULL").select(*KEYS).join(langs, "lang", "left").join(sizes, KEYS, "left").select(*KEYS, zero("terms"), zero("lang_total"), zero("total"))
    base = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(0)
    groups = staged(groups.withColumn("base", base), "term-groups")
    shares = staged(
        entries.join(small(groups), KEYS).select(*KEYS, "term", "base", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")), "term-shares"
    )

    # Two sources: the terms that one has against the other's baseline, then what changes where both have them.
    one = groups.select("lang", F.col("source").alias("a"), F.col("base").alias("za"), "terms")
    two = groups.select("lang", F.col("source").alias("b"), F.col("base").alias("zb"))
    alike = staged(shares.groupBy(*KEYS, "base", "p").agg(F.count(F.lit(1)).alias("m")), "alike-shares")
    own = alike.join(small(two), "lang").where("source <> b")
    own = own.select("lang", F.least("source", "b").alias("a"), F.greatest("source", "b").alias("b"), (F.col("m") * (F.abs(F.col("p") - F.col("zb")) - F.abs(F.col("base") - F.col("zb")))).alias("value"))
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("base").alias("za"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("base").alias("zb"))
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = left.join(right, ["lang", "term"]).where("a < b").select("lang", "a", "b", (gap("pa", "pb") - gap("pa", "zb") - gap("za", "pb") + gap("za", "zb")).alias("value"))
    fixed = own.groupBy("lang", "a", "b").agg(F.sum("value").alias("fix")).unionByName(both.groupBy("lang", "a", "b").agg(F.sum("value").alias("fix")))
    fixed = staged(fixed.groupBy("lang", "a", "b").agg(F.sum("fix").alias("fix")), "pair-corrections")
    pairs = one.join(small(two), "lang").where("a < b").join(fixed, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "a", "b", (F.col("terms") * gap("za", "zb") + F.coalesce("fix", F.lit(0).cast("long"))).alias("value"))
    turned = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    above = shares.where("p > q").select(*KEYS, F.col("term"), (F.col("p") - F.col("q")).alias("value"))
    tops = top_terms(above, most).select(*KEYS, F.col("term").cast("string").alias("item"), "value")
    both_parts = turned.withColumn("part", F.lit("pair")).unionByName(tops.withColumn("part", F.lit("term")))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return both_parts.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))


DIVERGENCE_SQL = r"""WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    w AS (SELECT row_id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
    k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT row_id) >= 30),
    l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY ALL),
    n AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
    g AS (SELECT d.lang, d.source, coalesce(any_value(l.v), 0) AS v, coalesce(any_value(s.total), 0) AS total, any_value(l.lang_total) AS lang_total
      FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN l ON d.lang = l.lang LEFT JOIN (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL) s ON d.lang = s.lang AND d.source = s.source GROUP BY ALL),
    p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (g.total + 5 * g.v) AS p, 1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (g.lang_total + 5 * g.v) AS q
      FROM g JOIN k ON g.lang = k.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
    o AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
    r AS (SELECT lang, source, 'pair' AS part, item, value FROM o UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM r QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50"""
