"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 200) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; ``root`` is the smallest node that links reach.

    Each round (1) takes the smallest label among a node's neighbours, (2) hands the smallest label that any
    member found to the whole current component (hooking at the root) and (3) follows each label to its own label.
    Chains halve each round, so rounds grow with the logarithm of a component's size.
    Labels of up to 500,000 nodes are broadcast; beyond that both sides of every join are scans of written tables, so
    adaptive execution can split a hub's partition. Aggregates combine before they shuffle. Only row counts reach the driver.

    Null ends and self links are ignored; repeated links count once; no links give an empty table.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    e = scratch.write(e)
    n = 2 * e.count()
    e = scratch.write_small(e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), n)
    labels = scratch.write_small(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), n)
    n = labels.count()
    for _ in range(max_rounds):
        near = e.join(bounded(labels.withColumnRenamed("node", "b"), n), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        cand = scratch.write_small(near.join(bounded(labels, n), "node").select("node", "root", F.least("root", "seen").alias("seen")), n)
        hook = scratch.write_small(cand.groupBy("root").agg(F.min("seen").alias("low")).where("low < root"), n)
        if hook.isEmpty():
            return labels
        fresh = scratch.write_small(cand.join(bounded(hook, n), "root", "left").select("node", F.coalesce("low", "root").alias("root")), n)
        # a root is a node too: following its own label halves what is left of a chain
        above = bounded(fresh.select(F.col("node").alias("root"), F.col("root").alias("top")), n)
        labels = scratch.write_small(fresh.join(above, "root", "left").select("node", F.least("root", "top").alias("root")), n)
        scratch.drop(cand)
        scratch.drop(fresh)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
