"""Connected components of an edge table, by least labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def connected(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges`: component is the least node reachable.

    Each round takes the least label of the neighbours and then that label's own; a round's labels are checkpointed, and the count of
    labels that changed ends the loop. Labels never rise, so a long path takes about the logarithm of its length.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(b, a)).where("node is not null and other is not null").distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        moved = checkpointed(lower.join(jump, "low").select("node", "component", F.least("low", "far").alias("next")))
        changed = moved.where("next <> component").limit(1).count()
        labels = moved.select("node", F.col("next").alias("component"))
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
