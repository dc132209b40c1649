"""Connected components of a graph given as edges, by rounds of least labels; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.session import cut, unsized


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b); a component is known by its least node.

    Each round takes the least label among the neighbours and then the label of that label, so that long chains halve. The
    labels of each round are written to the shared folder, until a round moves none. Loops and repeated edges do no harm; no edges give no rows.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("root"))
        moved = cut(lower.join(jump, "new", "left").select("node", F.least("new", F.coalesce("root", "new")).alias("component"), (F.col("component") > F.least("new", F.coalesce("root", "new"))).alias("moved")))
        moved = unsized(moved)
        labels = moved.select("node", "component")
        if moved.where("moved").isEmpty():
            return labels
