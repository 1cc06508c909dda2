"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.tables import stored


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is the
    smallest node that can be reached.  A node and itself may be linked.

    Every round, a node takes the smallest label around it and then the label of
    that label, so a chain of n nodes needs about log n rounds.  Rounds end when no
    label changes.  A node with very many links costs one partial minimum a task.
    """
    both = stored(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    for _ in range(max_rounds):
        around = (both.join(labels, both.b == labels.node)
                  .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        closer = labels.join(around, "node", "left").select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("component").alias("beyond"))
        new = stored(closer.join(jump, "now", "left").select(
            "node", "was", F.least("now", "beyond").alias("component")), "labels")
        if new.filter("component <> was").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
