"""Connected components of an edge table, by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hindcast.llm.common import stored


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the root is one node of the
    component.

    Each round points every node to its smallest neighbour if that is smaller, follows
    the pointers to their ends by doubling, and replaces the edges by those between
    ends.  A component at least halves its nodes in a round, so rounds grow with the
    logarithm of its size.  Every step is a written table; nothing is kept by lineage.
    """
    edges = stored(spark, edges.select("a", "b").where("a <> b").distinct(), "graph-edges")
    total: DataFrame | None = None
    while True:
        ends = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "next")
        up = ends.groupBy("node").agg(F.least("node", F.min("next")).alias("root"))
        while True:
            far = up.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
            up = stored(spark, up.join(far, "root").select(
                "node", F.col("beyond").alias("root"), (F.col("beyond") != F.col("root")).alias("moved")), "graph-roots")
            moved = not up.where("moved").isEmpty()
            up = up.drop("moved")
            if not moved:
                break
        if total is None:
            total = up
        else:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
            total = stored(spark, total.join(step, "root", "left").select(
                "node", F.coalesce("beyond", "root").alias("root")), "graph-components")
        edges = relabelled(edges, up)
        edges = stored(spark, edges.distinct(), "graph-edges")
        if edges.isEmpty():
            return total


def relabelled(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between the roots of their ends, without those inside one component.
    A node that ``roots`` does not hold is its own root."""
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias(end), "root")
        edges = edges.join(own, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    return edges.where("a <> b")
