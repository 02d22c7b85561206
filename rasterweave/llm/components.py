"""Connected components of a link table by smallest-label propagation with pointer jumping.

Defined cases: repeated links and links in both directions are one link; a link of a node with itself, or with null, is
none; nodes without any other link are not in the result; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.shared import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours, then the label's label, until nothing
    changes; both halve paths, so rounds grow with the logarithm of a component's length. All state is tables.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = materialize(lower, "labels")
        up = lower.select(F.col("node").alias("up_node"), F.col("label").alias("up_label"))
        jumped = lower.join(up, lower["label"] == up["up_node"], "left").select("node", "old", F.coalesce("up_label", "label").alias("label"))
        new = materialize(jumped, "labels")
        moved = new.filter("label <> old").limit(1).count()
        discard(lower)
        discard(labels)
        labels = new.drop("old")
        if not moved:
            return labels
