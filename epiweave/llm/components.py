"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def _is_settled(e: DataFrame) -> bool:
    """Whether the edges (u > v) are stars around their smallest nodes: each u has one edge and is nobody's v."""
    ends = e.select("u", F.lit(1).alias("a"), F.lit(0).alias("b")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a > 1 or (a > 0 and b > 0)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(src, dst long) -> (node, comp): comp is the smallest node reachable from node.

    Nulls and self-loops are left out, repeated edges count once, no edges give no rows. Each round is
    four joins or aggregations on the node with pre-aggregated minima, so a node with very many edges is
    one aggregated row on one side and a splittable join on the other. Lineage is cut after every round
    by a table in the shared folder; rounds grow with the logarithm of the longest path.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = stage(e, "edges")
    for _ in range(most_rounds):
        if _is_settled(e):
            break
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        was, e = e, stage(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        unstage(was)
    else:
        raise RuntimeError("connected components did not settle")
    root = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return root.union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def forest_components(edges: DataFrame) -> DataFrame:
    """As `components`, for graphs of many more edges than nodes.

    Each node's edge to its smallest neighbour comes first, a forest of fewer edges than nodes; of the other
    edges only those between two trees are left for a second run.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = stage(e, "links")
    first = components(e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("src"), F.col("v").alias("dst")))
    trees = stage(first, "trees")
    a, b = (trees.select(F.col("node").alias(end), F.col("comp").alias(name)) for end, name in (("u", "src"), ("v", "dst")))
    across = e.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("src", "u").alias("src"), F.coalesce("dst", "v").alias("dst"))
    across = stage(across.where("src <> dst"), "across")
    if across.isEmpty():
        unstage(e, across)
        return trees
    joined = stage(components(across), "joined")
    unstage(e, across)
    root = joined.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    inner = trees.join(root, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
    return inner.union(joined.join(trees, "node", "left_anti").select("node", "comp"))
