"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node of its component.

    Every round hooks each node's label to the smallest label next to it and then jumps to the label's label, so the rounds grow with the
    logarithm of the longest chain rather than its length. Only minima are grouped, so that a hub costs one row a task;
    nothing is collected but the number of changes. Each round is written to the shared folder.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct()
    both = materialise(both, "cc-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        # The old label's owner learns of the lower label too, so that whole trees move at once.
        roots = hooked.groupBy(F.col("label").alias("node")).agg(F.min("low").alias("root"))
        moved = hooked.join(roots, "node", "left").select("node", F.col("label").alias("old"), F.least("low", F.coalesce("root", "low")).alias("low"))
        jump = moved.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = moved.join(jump, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("label"), (F.least("low", F.coalesce("lower", "low")) != F.col("old")).alias("changed"))
        new = materialise(new, "cc-labels")
        labels = new.select("node", "label")
        if new.where("changed").isEmpty():
            return labels
    raise RuntimeError(f"components still change after {max_rounds} rounds")
