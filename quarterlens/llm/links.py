"""Connected components of a graph of long ids, with DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): the least node that it is connected with.

    Each round takes the least label among a node and its neighbours and then the label of that label, so that chains halve; it
    ends when no label changes. Labels are summed within tasks before they move, and adaptive execution splits the rows of
    a node with very many neighbours.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()
    both = stored(spark, both, "links-edges")
    labels = stored(
        spark, both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("l")).select("node", F.least("node", "l").alias("label")), "links-labels"
    )
    while True:
        near = (
            both.join(labels.select("node", "label"), both["b"] == F.col("node"))
            .groupBy(F.col("a").alias("x"))
            .agg(F.min("label").alias("least"))
        )
        stepped = labels.select("node", "label").join(near, F.col("node") == F.col("x")).select(
            "node", F.col("label").alias("old"), F.least("label", "least").alias("label")
        )
        stepped = stored(spark, stepped, "links-step")
        to = stepped.select(F.col("node").alias("y"), F.col("label").alias("further"))
        jumped = stepped.join(to, stepped["label"] == to["y"]).select(
            "node", F.least("label", "further").alias("label"), "old"
        )
        jumped = stored(spark, jumped, "links-labels")
        discard(labels, stepped)
        labels = jumped
        if jumped.filter("label <> old").isEmpty():
            discard(both)
            return jumped.select("node", F.col("label").alias("component"))
