"""Connected components of a table of links, by alternating large and small stars.

Each round links every node to the smallest node that it or its neighbours know; rounds grow with the logarithm of the
longest path. Tables of a round are staged, so lineage stays short and a lost executor repeats one round at most. Each
node's least neighbour is staged too: a hub's links then meet it by a broadcast, or by a join of two plain exchanges,
which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stage, unstage


def _met(links: DataFrame, least: DataFrame) -> DataFrame:
    """links a, b with m, the least of a's neighbours."""
    return links.join(small(least), F.col("a") == F.col("n"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")))
    out = stage(_met(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
    unstage(least, links)
    return out


def _small_star(links: DataFrame) -> DataFrame:
    least = stage(links.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")))
    moved = _met(links, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = stage(moved.unionAll(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct())
    unstage(least, links)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, root for links a, b (longs): root is the component's smallest node. Roots have a row too. Staged."""
    now = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = _small_star(_large_star(now))
        got = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if got == mark:
            break
        mark = got
    out = stage(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
    unstage(now)
    return out
