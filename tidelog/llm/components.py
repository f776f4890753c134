"""Connected components by contraction, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node that is reachable) of every node of the edges
    ``a, b``. Each round points every node to its smallest neighbour, follows that pointer
    once, and contracts; the edges shrink until none joins two components."""
    two_ways = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = cut(two_ways.where("a <> b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = nodes.withColumn("component", F.col("node"))
    while not links.isEmpty():
        least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = cut(least)
        jumped = least.select(F.col("a").alias("m"), F.col("m").alias("r"))
        moved = cut(least.join(jumped, "m").select("a", "r"))
        from_, to = moved.select("a", F.col("r").alias("ra")), moved.select(F.col("a").alias("b"), F.col("r").alias("rb"))
        pointers = moved.select(F.col("a").alias("component"), "r")
        labels = cut(
            labels.join(pointers, "component", "left").select("node", F.coalesce("r", "component").alias("component"))
        )
        links = links.join(from_, "a").join(to, "b").where("ra <> rb")
        links = cut(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    # A component's label is a node of it, not always the smallest one.
    smallest = labels.groupBy("component").agg(F.min("node").alias("least"))
    return labels.join(smallest, "component").select("node", F.col("least").alias("component"))
