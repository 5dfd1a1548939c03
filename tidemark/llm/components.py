"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node it is linked with.

    Each round hangs all neighbours of a node below the smallest of them, first the larger ones, then
    the smaller ones, until nothing changes; the number of rounds grows with the logarithm of the
    longest chain. Smallest neighbours come from partial aggregates and a join that Spark splits, so
    a node with very many links is no hot task. Each round is written to the shared folder.
    """
    links = written(ordered(links), "links")
    state = _state(links)
    while True:
        links = written(_small_star(_large_star(links)), "links")
        before, state = state, _state(links)
        if state == before:
            return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
                links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            )


def ordered(links: DataFrame) -> DataFrame:
    """Each link once, with a < b."""
    a, b = F.least("a", "b"), F.greatest("a", "b")
    return links.where("a != b").select(a.alias("a"), b.alias("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(smallest, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    smallest = links.groupBy("b").agg(F.min("a").alias("m"))
    hung = links.join(smallest, "b").where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return hung.union(smallest.select(F.col("m").alias("a"), "b")).distinct()


def _state(links: DataFrame) -> tuple:
    """Count and checksum of all links: equal if, but for one chance in 2^64, they are the same."""
    check = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    return tuple(links.agg(F.count(F.lit(1)), check).first())
