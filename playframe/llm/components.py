"""Connected components of a table of links, in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from playframe.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links`` (a, b) -> (node, root) for every node that has a link; the root
    is a member of the component. Each round hooks a node to its smallest
    neighbour, follows the hooks to their ends and contracts the links, so the
    rounds grow with the logarithm of the longest path. No links: no rows."""
    edges = scratch.keep(links.select("a", "b").filter("a <> b").distinct())
    roots: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("root")))
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = scratch.keep(hook.join(up, "root", "left").select(
                "node", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")))
            scratch.drop(hook)
            moved = not jumped.filter("moved").isEmpty()
            hook = jumped.select("node", "root")
            hook._kept_at = jumped._kept_at
            if not moved:
                break
        if roots is None:
            merged = hook
        else:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            merged = scratch.keep(roots.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
            scratch.drop(roots)
        left = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        again = scratch.keep(edges.join(left, "a").join(right, "b").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a <> b").distinct())
        scratch.drop(edges)
        if roots is not None:
            scratch.drop(hook)
        edges, roots = again, merged
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
