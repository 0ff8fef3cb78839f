"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.plans.materialise import materialise


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of ``edges`` (a long, b long).

    Each round hooks a node and its parent under the smallest grandparent seen across its
    edges and halves the paths, so that the number of rounds grows with the logarithm of
    the longest path.  Minima are combined before they are shuffled, so a hub is no
    bottleneck; every round is written to the shared folder.  Self-loops, repeated edges
    and an empty table are fine; edges with a null end are ignored.
    """
    clean = edges.where("a is not null and b is not null")
    both = materialise(clean.union(clean.select("b", "a")).toDF("u", "v").distinct(), "edges")
    parent = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")).select(F.col("u").alias("node"), "p"), "labels")
    for _ in range(max_rounds):
        up = parent.select(F.col("node").alias("p"), F.col("p").alias("g"))
        grand = materialise(parent.join(up, "p").select("node", "p", "g"), "labels")
        near = both.join(grand.select(F.col("node").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("m"))
        near = grand.join(near, grand["node"] == near["u"]).select("node", "p", "m")
        offers = near.select("node", F.col("m").alias("o")).union(near.select("p", "m")).union(grand.select("node", "g"))
        new = materialise(offers.groupBy("node").agg(F.min("o").alias("p")), "labels")
        changed = new.join(parent.withColumnRenamed("p", "old"), "node").where("p <> old").limit(1).count()
        parent = new
        if not changed:
            return parent.select("node", F.col("p").alias("component"))
    raise RuntimeError("components did not settle")
