"""Connected components of links between numbers, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; the root is the smallest node reachable.

    Each round hangs the larger neighbours of every node on its smallest one (large star), then
    the smaller ones (small star). Every round is written to the shared folder. Minima are combined
    before they are shuffled and written, so that the joins are of plain tables, which adaptive
    execution splits where a node is hot.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m")), "least-neighbours")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large, "large-star")  # repeats go with the small star; a distinct here would keep a hot node in one task
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least-of-star")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, staged(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        release(last, least, large, low)
