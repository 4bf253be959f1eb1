"""Connected components by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) for every id of nodes: the least id reachable over the links (a, b), taken both ways.

    Nodes without links are their own component; links to ids that aren't nodes are left out, null ids too.
    Every round takes the least label around a node and then that label's own label, so that long chains
    shorten by more than a step a round. Each round reads the links once and is checkpointed.
    """
    ids = nodes.select("id").where("id IS NOT NULL").distinct()
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    both = cut(both.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"))
    labels = cut(ids.withColumn("component", F.col("id")))
    while True:
        around = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        moved = labels.join(around, "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("on"))
        after = cut(moved.join(jump, "to").select("id", "was", F.least("to", "on").alias("component")))
        if not after.where("component <> was").limit(1).count():
            return after.select("id", "component")
        labels = after.select("id", "component")
