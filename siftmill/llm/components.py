"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.session import written


def connected_components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b); root is the smallest reachable.

    Alternating large-star and small-star steps: every node hooks its larger
    neighbours, then its smaller ones, to the smallest it knows, until all links
    are stars around the roots. Each round is two aggregates and two joins by
    node; a round's links are a written table, so lineage stays short, and
    nothing but two numbers per round reaches the driver.
    """
    current = written(_ordered(links), "links")
    state = _state(current)
    while state[0]:
        large = _large_star(current)
        following = written(_small_star(large), "links")
        before, state = state, _state(following)
        current = following
        if state == before:
            break
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _ordered(links: DataFrame) -> DataFrame:
    """Each link once, from the larger node a to the smaller node b."""
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("bigint"))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    """For every node u and its neighbours v > u: a link from v to the least of u and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """For every node u and its smaller neighbours v: links from v and u to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("low"))
    hooked = links.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return hooked.unionByName(least.select("a", F.col("low").alias("b"))).distinct()
