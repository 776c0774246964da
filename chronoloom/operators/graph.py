"""Connected components by joins over edge tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame], a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node of each node's component, for every node of an edge.

    Each round every node takes the least label among its neighbours, its label
    is offered the same one (so whole trees of labels join, not single nodes),
    and both take the label of their label; the rounds needed grow about with
    the logarithm of the longest path.  Rounds go on until no label changes;
    labels only become smaller, so they end.  ``keep`` writes a table and reads
    it again; it cuts lineage without holding anything on one executor.  Only a
    count of changes comes to the driver.  Edges with a null end are ignored.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    both = keep(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = keep(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    changed = True
    while changed:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        taken = keep(labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "taken")
        # only offers that differ from the label they go to
        hooks = taken.filter("label <> old").groupBy(F.col("old").alias("hook_node")).agg(F.min("label").alias("hook"))
        hooked = taken.join(hooks, F.col("node") == F.col("hook_node"), "left").select("node", "old", F.least("label", "hook").alias("label"))
        up = hooked.select(F.col("node").alias("up_node"), F.col("label").alias("up_label"))
        jumped = hooked.join(up, F.col("label") == F.col("up_node"), "left").select("node", "old", F.least("label", "up_label").alias("label"))
        after = keep(jumped, "labels")
        labels = after.select("node", "label")
        changed = after.filter("old <> label").limit(1).count() > 0
    return labels.select("node", F.col("label").alias("component"))
