"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinetrail.llm.store import written


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """links(a, b) with a > b to (id, component): the smallest id that links reach; ids without links have no row. known: components of earlier links, which links adds to.

    Each round is two aggregations and joins over the remaining links, written to the shared folder; the number of rounds grows with
    the logarithm of the longest chain. The rounds end as soon as the links are stars, without one more to see that nothing changes. Nothing is collected but a count.
    """
    edges = links.select("a", "b")
    if known is not None:
        edges = edges.union(known.where("component < id").select("id", "component"))
    edges = edges.distinct()
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x")).select(F.col("x.a").alias("a"), F.col("x.m").alias("b")).where("a > b").distinct()
        edges = written(small, "stars")
        if not _chained(edges):
            break
    pairs = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return pairs.union(edges.select(F.col("b"), F.col("b")).distinct())


def _chained(edges: DataFrame) -> int:
    """Ids that keep the links from being stars: those with two smaller ones, or with a smaller and a larger one. A star's centre is the smallest of its ids."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg((F.sum("up") + F.max("down")).alias("n"), F.max("up").alias("up")).where("up = 1 and n > 1").agg(F.count("*")).first()[0]
