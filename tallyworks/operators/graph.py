"""Connected components of links, by labels that spread and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.sources.shared import checkpointed


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that links reach) of all nodes of links (a, b); links of one node to itself are allowed.

    In each round a node takes the least label among its neighbours', then its label's own label;
    so paths shorten to half their length or less. Rounds end when no label changes. A node with
    very many links is one key of a join, which Spark splits when it is skewed, and of a minimum,
    which is taken before the exchange.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).union(links.select("a", F.col("a").alias("b"))).union(links.select(F.col("b").alias("a"), "b")).distinct()
    edges = checkpointed(both)
    labels = checkpointed(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")))
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        of = near.select(F.col("a").alias("of_node"), F.col("near").alias("of_component"))
        jumped = near.join(of, F.col("near") == F.col("of_node")).select(F.col("a").alias("node"), F.least("near", "of_component").alias("component"))
        new = checkpointed(jumped)
        changed = new.join(labels.withColumnRenamed("component", "before"), "node").filter("component <> before").limit(1).count()
        labels = new
        if not changed:
            return labels
