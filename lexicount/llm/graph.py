"""Connected components of an edge table, by contraction; nothing is gathered on the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _flattened(parents: DataFrame) -> DataFrame:
    """node, root from node, root where roots may point on: pointer jumping until nothing moves."""
    while True:
        up = parents.select(F.col("node").alias("up"), F.col("root").alias("top"))
        nxt = cut(parents.join(up, F.col("root") == F.col("up"), "left")
                  .select("node", F.coalesce("top", "root").alias("root"),
                          (F.coalesce("top", "root") != F.col("root")).alias("moved")), "graph-jump")
        if nxt.filter("moved").isEmpty():
            return nxt.select("node", "root")
        parents = nxt.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b); the component is its smallest node.

    Each round hangs every node on its smallest neighbour, flattens the trees
    and replaces the edges by those between different roots, so the edge table
    shrinks every round (stars end after one or two).
    """
    left = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
               "graph-edges")
    result: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = cut(both.groupBy("a").agg(F.min("b").alias("b"))
                      .select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "graph-parents")
        roots = _flattened(parents)
        r1 = roots.select(F.col("node").alias("n1"), F.col("root").alias("ra"))
        r2 = roots.select(F.col("node").alias("n2"), F.col("root").alias("rb"))
        left = cut(left.join(r1, F.col("a") == F.col("n1")).join(r2, F.col("b") == F.col("n2"))
                   .filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
                   .distinct(), "graph-edges")
        if result is None:
            result = roots
        else:
            up = roots.select(F.col("node").alias("up"), F.col("root").alias("top"))
            result = cut(result.join(up, F.col("root") == F.col("up"), "left")
                         .select("node", F.coalesce("top", "root").alias("root")), "graph-roots")
    if result is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return result.select("node", F.col("root").alias("component"))
