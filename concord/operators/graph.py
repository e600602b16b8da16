"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame], src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node of each connected component; nodes are those with an edge.

    Each round takes the smallest label among a node's neighbours, then the
    label of its label, so long chains take a logarithmic number of rounds.
    Neighbours' labels are aggregated before the shuffle, but the join before it
    brings all edges of a node together, and only adaptive execution splits those
    of a node with very many.  ``keep`` stores a round's result and cuts its
    lineage (a checkpoint, or a table in a shared folder).  Edges with a null
    end and loops are left out; repeated edges do no harm.
    """
    ends = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src is not null and dst is not null and src <> dst")
    both = keep(ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = keep(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("component")).withColumnRenamed("src", "node"), "labels")
    while True:
        near = both.join(labels, both["src"] == labels["node"]).groupBy("dst").agg(F.min("component").alias("near"))
        better = labels.join(near, labels["node"] == near["dst"], "left").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        better = keep(better, "labels")
        jump = better.select(F.col("node").alias("via"), F.col("component").alias("far"))
        jumped = better.join(jump, better["component"] == jump["via"]).select("node", "was", F.least("component", "far").alias("component"))
        jumped = keep(jumped, "labels")
        done = jumped.filter("component <> was").isEmpty()
        labels = jumped.select("node", "component")
        if done:
            return labels
