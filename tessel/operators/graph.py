"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): connected components of an undirected edge table, named by their least node.

    Every round takes the least label among the neighbours and then jumps to that label's own label, so long chains halve.
    Each round is checkpointed in the shared folder. Only nodes with an edge come out; null ends and loops are ignored.
    """
    clean = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = cut(clean.union(clean.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).withColumnRenamed("u", "node"))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        least = labels.join(near, F.col("node") == F.col("u")).select("node", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        moved = cut(least.join(jump, "to").select("node", "label", F.least("to", "further").alias("now")))
        changed = moved.where("label <> now").limit(1).count()
        labels = moved.select("node", F.col("now").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("more rounds are needed")
