"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verifold.llm.storage import Table, free, save


def connected(edges: DataFrame, most: int = 50) -> DataFrame:
    """node and root for each node of ``edges`` (columns a, b); root is the smallest node of the component.

    Each half of a step is one grouped minimum and one join; its edges are written to the shared folder
    and replace the last ones. Both halves in one plan would read the first one's plan four times over,
    and the driver keeps plans and their metrics. Nodes are never gathered: a star's centre is one row of the minimum.
    """
    spark = edges.sparkSession
    now = save(edges.where("a <> b").select("a", "b").distinct(), "edges")
    held = _sums(now.df)
    for _ in range(most):
        large = save(_large_star(now.df), "large")
        free(spark, now)
        table = save(_small_star(large.df), "edges")
        free(spark, large)
        sums = _sums(table.df)
        changed, held = sums != held, sums
        now = table
        if not changed:
            break
    else:
        raise RuntimeError(f"components are not settled after {most} steps")
    # Settled: every node but the root points at its root.
    high, low = F.greatest("a", "b"), F.least("a", "b")
    stars = now.df.select(high.alias("node"), low.alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _sums(edges: DataFrame) -> tuple:
    """Count and two 64-bit sums over distinct edges: as equal as the edges are, but for a chance of 2 ** -128."""
    forth, back = F.xxhash64("a", "b"), F.xxhash64("b", "a")
    return tuple(edges.agg(F.count("*"), F.bit_xor(forth), F.sum(back.cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour, itself included."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


__all__ = ["Table", "connected"]
