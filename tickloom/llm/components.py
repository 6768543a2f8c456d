"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a != b").distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Columns `a` and `b` (the smallest node that `a` reaches), for nodes that are not smallest.

    `links` has long columns a and b. Each step is written to the shared folder; the steps end
    when they change nothing, which a count and a checksum show. Nodes without links give no row.
    """
    now = scratch.stored("links-0", links.where("a != b").distinct())
    seen = _mark(now)
    step = 0
    while seen[0]:
        step += 1
        large = scratch.stored(f"large-{step}", _large_star(now))
        later = scratch.stored(f"links-{step}", _small_star(large))
        scratch.drop(f"large-{step}")
        scratch.drop(f"links-{step - 1}")
        now, before, seen = later, seen, _mark(later)
        if seen == before:
            break
    return now


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    ).first()
    return row.n, int(row.s or 0)
