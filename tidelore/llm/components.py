"""Connected components on DataFrames by hooking to the least neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): the least node it reaches.

    Each round joins every node that has a smaller neighbour to the least one, resolves the chains by pointer
    jumping and keeps the edges between what is left, so at least half of the connected nodes go per round.
    All state stays in tables.
    """
    edges = materialize(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up")), "hooks")
        while True:
            top = up.select(F.col("node").alias("up"), F.col("up").alias("_top"))
            nxt = materialize(up.join(top, "up").select("node", F.col("_top").alias("up"), (F.col("up") != F.col("_top")).alias("moved")), "hooks")
            up = nxt.select("node", "up")
            if nxt.filter("moved").isEmpty():
                break
        end = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"_{c}"))  # noqa: E731, B023
        label = up if label is None else materialize(label.join(up.select(F.col("node").alias("up"), F.col("up").alias("_top")), "up", "left").select("node", F.coalesce("_top", "up").alias("up")), "labels")
        edges = materialize(edges.join(end("a"), "a").join(end("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label.select("node", F.col("up").alias("component"))
