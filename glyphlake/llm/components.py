"""Connected components of a distributed edge table; nothing of the graph reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``a, b``): the smallest node that it reaches.

    Each round takes the least label of a node's neighbours, then the label of that label, so that labels
    travel twice as far every round; it ends when no label changed. Rounds are written to
    the shared folder. An empty table gives an empty result.
    """
    both = stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label"))
    labels = stored(labels, "labels")
    while True:
        near = both.join(labels.hint("merge"), both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        closer = labels.join(near.hint("merge"), labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("closer"))
        of_label = labels.select(F.col("node").alias("closer"), F.col("label").alias("further"))
        moved = closer.join(of_label.hint("merge"), "closer", "left").select("node", F.least("closer", F.coalesce("further", "closer")).alias("label"), (F.least("closer", F.coalesce("further", "closer")) < F.col("label")).alias("moved"))
        moved = stored(moved, "labels")
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels
