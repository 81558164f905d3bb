"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterkit.llm.common import written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node in ``links`` (columns a, b, any orderable type, no nulls).

    Each round every node takes its smallest neighbour as parent and links are redrawn between
    parents; nodes that are digests lose a constant share per round, so rounds grow with the
    logarithm of the longest chain. Each round is written to the shared folder. ``root`` is the
    same for all nodes of a component. No link or label is collected: the driver sees one count
    per round.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), f"{name}-links")
    label = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    label = written(label, f"{name}-nodes")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("child"), F.least("a", "b").alias("parent"))
        parent = written(parent, f"{name}-parents")
        label = label.join(parent, label["root"] == parent["child"], "left").select("node", F.coalesce("parent", "root").alias("root"))
        label = written(label, f"{name}-nodes")
        left = parent.select(F.col("child").alias("a"), F.col("parent").alias("pa"))
        right = parent.select(F.col("child").alias("b"), F.col("parent").alias("pb"))
        edges = edges.join(left, "a").join(right, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = written(edges.distinct(), f"{name}-links")
    return label
