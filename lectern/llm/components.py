"""Connected components of an edge table by alternating large-star and small-star rounds.

Rounds grow with the logarithm of the longest chain, edges never grow beyond the input, nothing is collected, and every
round's edges are a table in the shared folder, so a lost executor costs a retry of one round.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, measured


def _edges(df: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and what tells whether they changed: their number and a sum of their hashes."""
    kept, seen = measured(df, "edges", sum=F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")))
    return kept, (seen["rows"], seen["sum"])


def connected_components(links: DataFrame) -> DataFrame:
    """links(x, y) -> (node, component): component is the smallest node reachable. Nodes without links are not listed."""
    edges, now = _edges(links.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    before = None
    while now[0] and now != before:
        before = now
        # Large star: each node's larger neighbours link to the smallest of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("low"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("low").alias("y")).distinct()
        # Small star: the node and its smaller neighbours link to the smallest of them.
        low = large.groupBy("x").agg(F.min("y").alias("low"))
        small = large.join(low, "x").select(F.col("y").alias("x"), F.col("low").alias("y")).unionByName(low.select("x", F.col("low").alias("y")))
        edges, now = _edges(small.where("x <> y").distinct())
    return edges.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(
        edges.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct()
    )


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (of connected_components) after further links(x, y): only the components that the links touch are labelled
    anew, as the nodes of a smaller graph."""
    end = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    ends = links.join(end("x"), "x", "left").join(end("y"), "y", "left").select(F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y"))
    more = connected_components(ends)
    moved = labels.join(more.select(F.col("node").alias("component"), F.col("component").alias("_new")), "component", "left")
    moved = moved.select("node", F.coalesce("_new", "component").alias("component"))
    return durable(moved.unionByName(more.join(labels.select("node"), "node", "left_anti")), "labels")
