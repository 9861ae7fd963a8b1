"""Connected components of an undirected edge table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on edges (a, b): each node points its larger (or, if small, its
    smaller) neighbours, and itself, at the least node it sees."""
    if small:
        sides = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = sides.join(least, "u")
    if small:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    else:
        out = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges (a, b); component is the least node id of
    the connected component.

    Alternating large-star and small-star steps; each round ends in a written table, and
    the rounds stop when the edge set no longer changes. Self-loops and null ids are ignored;
    an empty edge table gives an empty result.
    """
    edges = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )

    def state(df):
        # a star forest is the fixed point: every edge points at a node that has no outgoing edge
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    before = state(edges)
    while before[0]:
        edges = materialize(_star(_star(edges, False), True))
        after = state(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
