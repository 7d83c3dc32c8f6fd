"""Connected components as joins: no edge or label reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """`node`, `comp` (the smallest node reachable) for every node of `edges` (a, b).

    Each round takes the smallest label among a node and its neighbours, then
    the label of that label, so chains shorten by half; a hot node's labels are
    combined before the shuffle. Every round is written, which cuts the lineage.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        least = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", "comp", F.least("comp", "near").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("comp").alias("up"))
        step = written(least.join(up, "next").select("node", F.least("next", "up").alias("comp"),
                                                     (F.least("next", "up") < F.col("comp")).alias("moved")), "labels")
        labels = step.drop("moved")
        if step.filter("moved").isEmpty():
            return labels
