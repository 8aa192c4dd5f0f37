"""Connected components by contraction: hook to a smaller neighbour, then jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in ``links``: the smallest id reachable.

    Each round keeps one row per node, hooks every root to its smallest
    neighbouring root, and flattens the trees by pointer jumping, so the graph of
    roots at least halves where it has links left; no list of neighbours is ever
    gathered. Loops, repeated links and an empty table are fine; a null end is no
    link."""
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    alone = edges.where("a = b").select("a")
    edges, rows = sized(staged(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    label = None
    while rows:
        hooks, n = sized(staged(edges.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("up"))))
        above = lambda: hooks.select(F.col("root").alias("up"), F.col("up").alias("top"))
        while not hooks.join(above(), "up", "left_semi").isEmpty():  # an up that isn't a root of this round
            hooks, n = sized(staged(hooks.join(above(), "up", "left").select("root", F.coalesce("top", "up").alias("up"))), n)
        to = lambda column, name: hooks.select(F.col("root").alias(column), F.col("up").alias(name))
        if label is None:  # every node is a root of this round or the smaller end of a link
            nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
            label = nodes.join(to("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        else:
            label = label.join(to("component", "top"), "component", "left").select("id", F.coalesce("top", "component").alias("component"))
        label = sized(staged(label))[0]
        edges = edges.join(to("a", "top_a"), "a", "left").join(to("b", "top_b"), "b")
        edges = edges.select(F.coalesce("top_a", "a").alias("x"), F.col("top_b").alias("y")).where("x != y")
        edges, rows = sized(staged(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()))
    alone = alone.distinct().select(F.col("a").alias("id"), F.col("a").alias("component"))
    return alone if label is None else label.union(alone.join(label, "id", "left_anti"))
