"""Connected components of links by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns ``a, b``): the smallest node that is reachable.

    Large-star ties each larger neighbour of a node to the smallest one around it; small-star ties a node and its
    smaller neighbours to the smallest of them. Both keep what is connected, and in turns they end in stars, in
    about the logarithm of the number of nodes many rounds. The minimum of a node's neighbours is an aggregation,
    so a node with very many links is no single task's work; the minima are dealt once more before they are joined with
    the links, so that Spark can split a common node's links over many tasks. Each round is written to the shared
    folder, and the one before it deleted. Links in
    either direction, repeated links and links of a node with itself may be given; nulls are left out.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a IS NOT NULL AND a <> b").distinct()
    edges = written(edges, "links")
    before = _state(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least.repartition(F.xxhash64("u")), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.repartition(F.xxhash64("a")), "a")
        ends = F.explode(F.array(F.struct(F.col("a").alias("a")), F.struct(F.col("b").alias("a"))))
        last, edges = edges, written(small.select(ends.alias("e"), F.col("m").alias("b")).select("e.a", "b").where("a <> b").distinct(), "links")
        discard(last)
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
