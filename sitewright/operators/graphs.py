"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (or not larger) neighbours on its smallest one."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.join(least, "u")
    if large:
        hung = hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        hung = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def components(pairs: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component) for every end of the links: the smallest node that links reach.

    Rows of links to hubs are pre-aggregated to their smallest end; every round
    is written to the shared folder, and rounds grow with the logarithm of the
    longest path. A node that only has a link to itself is its own component;
    links with a null end do nothing.
    """
    edges = pairs.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    now, mark = edges.where("a <> b"), None
    while True:
        now = cut(_star(_star(now, True), False), "stars")
        sums = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (sums["n"], sums["x"]) == mark:
            break
        mark = (sums["n"], sums["x"])
    hung = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = now.select("b").unionByName(edges.where("a = b").select("b").join(now.select(F.col("a").alias("b")), "b", "left_anti")).distinct()
    return hung.unionByName(roots.select(F.col("b").alias("id"), F.col("b").alias("component")))
