"""Transitive closure over a parent column, safe with cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import saved


#: a tree of at most so many edges is walked on the driver, in one job
SMALL_TREE = 50_000


def subtree(tree: DataFrame, roots: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """(id) of ``roots`` (id) and everything below. A node is visited once, so cycles end. Small trees take one bounded job; of others each pass joins only the last level."""
    edges = tree.select(F.col(node).alias("_child"), F.col(parent).alias("_parent"))
    start = roots.select(F.col("id").alias("_child"), F.lit(None).cast(edges.schema["_parent"].dataType).alias("_parent"), F.lit(True).alias("_root"))
    listed = edges.where("_parent is not null").withColumn("_root", F.lit(False)).unionByName(start).limit(SMALL_TREE + 1).collect()
    if len(listed) <= SMALL_TREE:
        below: dict = {}
        for r in listed:
            below.setdefault(r["_parent"], []).append(r["_child"])
        seen = dict.fromkeys(r["_child"] for r in listed if r["_root"])
        level = list(seen)
        while level:
            level = [c for p in level for c in below.get(p, ()) if c not in seen and not seen.setdefault(c)]
        return tree.sparkSession.createDataFrame([(x,) for x in seen if x is not None], T.StructType([T.StructField("id", edges.schema["_child"].dataType)]))
    seen = level = saved(roots.select(F.col("id")).distinct())
    while not level.isEmpty():
        below = level.join(edges, F.col("id") == F.col("_parent")).select(F.col("_child").alias("id")).distinct()
        level = saved(below.join(seen, "id", "left_anti"))
        seen = seen.unionByName(level)
    return seen


def in_cycles(tree: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """(id) of nodes on or below a cycle: what remains once nodes under a real root are taken off."""
    below_root = subtree(tree, tree.where(F.col(parent).isNull()).select(F.col(node).alias("id")), node, parent)
    orphans = tree.join(tree.select(F.col(node).alias("_p")), F.col(parent) == F.col("_p"), "left_anti").where(F.col(parent).isNotNull())
    rooted = below_root.unionByName(subtree(tree, orphans.select(F.col(node).alias("id")), node, parent)).distinct()
    return tree.select(F.col(node).alias("id")).join(rooted, "id", "left_anti")
