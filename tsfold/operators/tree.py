"""E: traversal of a flat node forest ``(project_id, node_id, parent_id,
sort_path, depth, kind, ...)``. ``sort_path`` joins zero-padded sibling keys
with '/', so a prefix sorts before its extensions (pre-order) and appending
'/~' (``~`` sorts after digits and '/') puts a parent after its subtree
(post-order). B13 leaf test included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import dense_rank_within


def preorder(nodes: DataFrame) -> DataFrame:
    """Parent before children, siblings in order; dense position."""
    return dense_rank_within(nodes, ["project_id"], ["sort_path"], "pre_ord")


def postorder(nodes: DataFrame) -> DataFrame:
    """Children before parent."""
    n = nodes.withColumn("_post", F.concat("sort_path", F.lit("/~")))
    return dense_rank_within(n, ["project_id"], ["_post"], "post_ord").drop("_post")


def ancestor_paths(sort_path: Column) -> Column:
    """Proper ancestor prefixes of a sort path: a/b/c -> [a, a/b]."""
    parts = F.split(sort_path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(parts, 1, i), "/"),
    )


def prune(nodes: DataFrame, skip: Column) -> DataFrame:
    """The visitor returns Skip for nodes matching ``skip``: they are still
    visited, their descendants are not (Stop behaves like Skip). Each node's
    ancestor prefixes are exploded (bounded by tree depth) and equi-joined
    with the skipped paths -- a hash join, not a nested-loop prefix match."""
    skipped = nodes.where(skip).select("project_id", F.col("sort_path").alias("_anc")).distinct()
    anc = nodes.where(F.size(F.split("sort_path", "/")) > 1).select(
        "project_id", "node_id", F.explode(ancestor_paths(F.col("sort_path"))).alias("_anc")
    )
    hidden = anc.join(skipped, ["project_id", "_anc"], "left_semi").select("project_id", "node_id").distinct()
    return nodes.join(hidden, ["project_id", "node_id"], "left_anti")


def leaf_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes without children (anti join on node_id = parent_id)."""
    parents = nodes.where(F.col("parent_id").isNotNull()).select(
        "project_id", F.col("parent_id").alias("node_id")
    ).distinct()
    return nodes.join(parents, ["project_id", "node_id"], "left_anti")
