"""Connected components of an edge table, by labels that spread along edges and along themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import settled


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b) of longs; the component is its smallest node.

    A round gives each node the least label among itself and its neighbours, and then the label of that label, so a
    chain of n nodes takes about log n rounds.  Only labels and edges move, never the members of a component.
    """
    both = edges.select("a", "b").where("a <> b")
    both = settled(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component"))
    labels = settled(labels)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("low"))
        spread = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "low").alias("component"))
        spread = settled(spread)
        jump = spread.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = settled(spread.join(jump, "component").select("node", F.least("component", "root").alias("component"), "old"))
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return labels
