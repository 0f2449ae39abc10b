"""Connected components by contraction: every node joins its least neighbour, and the links are renamed, until none is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each node that has a link to another; component is a node of the same component, equal for all of it.

    links has long columns a and b; loops, repeats and both directions are fine. Each round at least halves the nodes
    that still have links, so the rounds grow with the logarithm of the largest component.
    """
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to")), "step")
        if labels is None:
            labels = step.select(F.col("node").alias("id"), F.col("to").alias("component"))
        else:
            labels = labels.join(step, labels.component == step.node, "left").select("id", F.coalesce("to", "component").alias("component"))
        labels = written(labels, "labels")
        a, b = step.select(F.col("node").alias("a"), F.col("to").alias("to_a")), step.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        renamed = links.join(a, "a").join(b, "b").where("to_a <> to_b")
        links = written(renamed.select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct(), "links")
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")) if labels is None else labels
