"""Connected components of a link table by repeated minimum and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest reachable node) for every node in `links`; direction doesn't matter.

    Every round, each node takes the smallest label among its neighbours, then the label of its label. Self links keep a
    node in the result. Links are never gathered; a node with very many links is summed up map-side.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b), F.col(a))).distinct()
    edges = materialize(both, "cc-edges")
    labels = materialize(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")).withColumnRenamed("x", "node"), "cc-labels")
    while True:
        # the smallest label around each node
        near = edges.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("x", "node"), "node").select("node", "label", F.least("label", "near").alias("to"))
        # hooking: a component's label takes the smallest label that any of its nodes saw
        hook = step.groupBy("label").agg(F.min("to").alias("hook")).withColumnRenamed("label", "old")
        moved = step.join(hook, step["label"] == hook["old"]).select("node", F.col("label").alias("was"), F.least("to", "hook").alias("label"))
        new = materialize(moved, "cc-labels")
        changed = new.where(F.col("was") != F.col("label")).limit(1).count()
        release(labels)
        labels = new.drop("was")
        labels._krylite_path = new._krylite_path
        if not changed:
            release(edges)
            return labels.withColumnRenamed("label", "component")
