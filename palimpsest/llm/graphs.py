"""Connected components as DataFrame rounds; no edge list or label ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Smallest reachable id of every node of an undirected graph: columns ``node``, ``label`` (long).

    Each round takes the smallest label of a node's neighbours, hooks it on the node's old label and then
    follows one pointer, so the number of rounds is logarithmic in the longest chain.  Every shuffle is
    either a ``min`` that combines before the exchange or a join that may be split where one label is hot.
    Self links and repeated links are harmless; null ends are ignored; an empty input has no nodes.
    """
    both = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).dropna()
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("low"))
        proposed = met.select("node", F.col("low").alias("to")).unionByName(
            met.filter(F.col("low") < F.col("label")).select(F.col("label").alias("node"), F.col("low").alias("to"))
        )
        hooked = materialize(proposed.groupBy("node").agg(F.min("to").alias("label")), "hooked")
        up = hooked.select(F.col("node").alias("top"), F.col("label").alias("over"))
        jumped = hooked.join(up, hooked["label"] == up["top"], "left").select("node", F.least("label", "over").alias("label"))
        new = materialize(jumped, "labels")
        was = labels.select(F.col("node").alias("n0"), F.col("label").alias("l0"))
        changed = new.join(was, new["node"] == was["n0"]).filter(F.col("label") != F.col("l0")).limit(1).count()
        release(labels)
        release(hooked)
        labels = new
        if not changed:
            release(both)
            return labels
