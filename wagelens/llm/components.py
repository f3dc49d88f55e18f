"""Connected components of a table of links, by repeated minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the root is the smallest node reachable.

    Each round a node takes the smallest label around it and then the label of that label, so a path
    shrinks by more than half; rounds are written to the shared folder. Labels only fall, and the
    loop ends when none does. A node with many links is summed in parts.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "cc-labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        near = labels.join(around, labels["node"] == around["a"]).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = labels.select(F.col("node").alias("up"), F.col("root").alias("top"))
        new = stored(
            near.join(up, near["root"] == up["up"], "left").select("node", "old", F.least("root", F.coalesce("top", "root")).alias("root")), "cc-labels"
        )
        labels = new.select("node", "root")
        if new.where("old <> root").isEmpty():
            return labels
