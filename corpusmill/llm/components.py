"""Connected components by label spreading over a two-sided graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut, drop_cut


def spread_labels(edges: DataFrame) -> DataFrame:
    """``edges(node, hub)``, both bigint -> ``(node, label)``.

    Nodes that share a hub, directly or over other nodes and hubs, get one label:
    the smallest node among them. First every hub gives way to its smallest node. Each round takes the minimum over a node's hubs
    of the minimum over the hub's nodes, and then the label of that label, so that
    the distance covered doubles. Rounds end when no label changes; each is a
    written table, so a lost executor costs one round at most.
    """
    edges = edges.select("node", "hub").where("node is not null and hub is not null")
    # a hub's nodes all hang on its smallest; nodes that share many hubs mostly share that one edge
    low = edges.groupBy("hub").agg(F.min("node").alias("low"))
    star = edges.join(low, "hub").select("node", F.col("low").alias("hub")).distinct()
    edges = cut(star.union(star.select(F.col("hub").alias("node"), "hub").distinct()).distinct())
    labels = cut(edges.groupBy("node").agg(F.min("hub").alias("label")))
    before = None
    while True:
        low = edges.join(labels, "node").groupBy("hub").agg(F.min("label").alias("low"))
        near = edges.join(low, "hub").groupBy("node").agg(F.min("low").alias("near"))
        far = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        step = cut(near.join(far, "near").select("node", F.least("near", "far").alias("label")))
        drop_cut(labels)
        labels = step
        # labels only ever fall, so an equal sum means that none fell
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            drop_cut(edges)
            return labels
        before = total
