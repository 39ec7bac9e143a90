"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge; the label is the component's least node. Edges are (a, b) longs."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
        step = step.join(up, F.col("label") == F.col("at"), "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        step = written(step, "labels")
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels
