"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    return (both.join(low, "u").filter("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge has u > v here
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    return (edges.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest
    node reachable.

    ``edges`` has two long columns u and v; self loops and repeats may occur.
    Large-star and small-star steps alternate until every node points at its
    smallest one.  A hub's neighbours are first reduced to their minimum by a
    partial aggregate and then joined back, so no task holds a whole hub; the
    edge table is written to the shared folder after each round.
    """
    cur = materialize(edges.filter("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        cur = materialize(_small_star(_large_star(cur)), "edges")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                      F.countDistinct("u")).first()
        # done: each node has one edge and nothing moved
        if mark == tuple(now) and now[0] == now[2]:
            break
        mark = tuple(now)
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
