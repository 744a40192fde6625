"""Connected components of an edge table, by rounds of smallest labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that links reach) for every node of the edges (a, b).

    Each round gives a node the smallest label among its own and its neighbours', then the label of that label, so
    stars take two rounds and chains a number that grows with the logarithm of their length or little more. Only the
    count of changed labels comes to the driver; labels are kept as written tables.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(near, labels["node"] == near["a"], "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        top = labels.select(F.col("node").alias("low"), F.col("component").alias("top"))
        moved = stored(low.join(top, "low", "left").select("node", "component", F.least("low", F.coalesce("top", "low")).alias("new")), "labels")
        changed = moved.where("new != component").limit(1).count()
        labels = moved.select("node", F.col("new").alias("component"))
        if not changed:
            return labels
