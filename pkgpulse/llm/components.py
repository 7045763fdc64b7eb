"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgpulse.llm.shared import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``: root is the smallest node
    reachable. Each round takes the smallest label among a node's neighbours
    (a map-side combined minimum, so a node with very many links costs one
    partial row per task), then the label's own label (pointer jumping); it
    ends when no label changes. Labels are written to the shared folder each
    round; the driver only sees the number of changed rows.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other")))
    both = both.where("node is not null and other is not null")  # a repeated link changes no minimum
    labels = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root"))
    labels = written(labels, "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("other"), F.col("root").alias("seen")), "other")
            .groupBy("node")
            .agg(F.min("seen").alias("seen"))
        )
        nearest = labels.join(near, "node").select("node", "root", F.least("root", "seen").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("lower"))
        jumped = nearest.join(jump, "low", "left").withColumn("new", F.least("low", F.coalesce("lower", "low")))
        step = written(jumped.select("node", F.col("new").alias("root"), (F.col("new") < F.col("root")).alias("moved")), "labels")
        labels = step.select("node", "root")
        if step.where("moved").isEmpty():
            return labels
