"""Connected components of a graph of long ids, by contraction.

In a round every node points to the smallest node it is linked to (itself included); the pointers form trees, are followed
to their roots, and the links are rewritten between roots. Nodes without links drop out, so the graph at least halves each
round. All steps are joins and minima with partial aggregation: no node's links meet in one task, however many it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long), where root is the smallest node of its component.

    Links may repeat, go either way or join a node to itself; nodes of self-links only are their own root; no links give
    an empty table. Rows with a null end are left out, as they join nothing.
    """
    links = stored(links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL"), "given-links")
    nodes = stored(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    found = nodes.withColumn("root", F.col("node"))
    rest = stored(links.filter("a <> b").distinct(), "links")
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up")).withColumnRenamed("a", "node")
        up = stored(up, "pointers")
        while True:  # every pass doubles how far a pointer reaches
            above = up.select(F.col("node").alias("up"), F.col("up").alias("further"))
            jumped = stored(
                up.join(above, "up").select("node", F.col("further").alias("up"), (F.col("further") < F.col("up")).alias("moved")),
                "pointers",
            )
            done = jumped.filter("moved").isEmpty()
            up = jumped.drop("moved")
            if done:
                break
        found = stored(
            found.join(up.withColumnRenamed("node", "root"), "root", "left")
            .select("node", F.coalesce("up", "root").alias("root")), "components",
        )
        ends = rest
        for end in ("a", "b"):
            ends = ends.join(up.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("up", end)
        rest = stored(ends.filter("a <> b").distinct(), "links")
    return found
