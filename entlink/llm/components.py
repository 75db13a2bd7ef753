"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entlink.session import persist_table


def components(edges: DataFrame, nodes: tuple[str, str] = ("a", "b")) -> DataFrame:
    """``(node, label)`` of every node that has an edge; nodes are one component
    where they share a label, the component's smallest node.

    Each round gives a node the smallest label among its own and its
    neighbours', then twice the label's own label, so long chains shorten fast.
    Rounds are cut by written tables; the joins have plain scans on either side,
    so that Spark can split a label that many nodes carry.
    """
    a, b = nodes
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = persist_table(both.union(both.select("other", "node")).distinct(), "cc-edges")
    labels = persist_table(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "cc-labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("seen"))
        hooked = persist_table(labels.join(seen, "node").select("node", F.least("label", "seen").alias("label"), F.col("label").alias("old")), "cc-hooked")
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = persist_table(hooked.join(jump, "label").select("node", "further", "old"), "cc-labels")
        changed = new.filter(F.col("further") != F.col("old")).limit(1).count()
        labels = new.select("node", F.col("further").alias("label"))
        if not changed:
            return labels
