"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b); a component is named by its smallest node.

    Each round a node takes the smallest label among its neighbours, then the
    label of its label, so labels jump along paths. Labels are written to the
    shared folder after each round and rounds end when none changes. A hub's
    edges meet in a join that Spark may split, followed by a partial minimum;
    no neighbour list is ever gathered.
    """
    pairs = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    # each node keeps its smallest neighbour, and the others are tied to that one: far fewer edges where hubs are few
    nearest = pairs.groupBy("a").agg(F.min("b").alias("near"))
    tied = pairs.join(nearest, "a").where("b <> near").select(F.col("b").alias("a"), F.col("near").alias("b"))
    both = nearest.select("a", F.col("near").alias("b")).union(tied).distinct()
    both = materialise(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        taken = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = materialise(taken.join(up, "component").select("node", F.least("component", "up").alias("component"), "was"))
        changed = jumped.where("component <> was").limit(1).count()
        discard(labels)
        labels = jumped
        if not changed:
            discard(pairs, both)
            return labels.select("node", "component")
