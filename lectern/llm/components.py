"""Connected components of links that stay distributed.

Alternating large-star and small-star steps turn the links into stars whose centre is each component's
smallest node. Each step's links are a table in the shared folder; the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch


def _both(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of it and its neighbours."""
    near = _both(links)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these; links are (smaller a, larger b)."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b")
    return moved.select(F.col("m").alias("a"), F.col("a").alias("b")).union(moved.select(F.col("m").alias("a"), "b")).where("a < b").distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root): each linked node and its component's smallest node; the smallest itself is there too.

    ``links`` has bigint columns a and b; nulls, loops and repeated links don't count.
    """
    now = scratch.save(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{name}-0")
    state, k = None, 0
    while True:
        k += 1
        now = scratch.save(_small_star(_large_star(now)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == state:
            break
        state = (row.n, row.h)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
