"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum followed by a join with it.  The minimum is written first, so
both sides of the join are plain exchanges and adaptive execution may split the partition of a
hub that a third of all edges share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.workspace import Workspace


def connected_components(ws: Workspace, edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``edges(a, b)``, about so many rows if that is known, two ids of one orderable type -> ``(node, root)``.

    root is the smallest id of the component.  Only nodes other than the root of components of
    two or more nodes are returned.  Null ends and loops are dropped, repeated and reversed
    edges count once; no edges give no rows.  The number of rounds grows with the logarithm of
    the largest component.
    """
    edges = edges.where(F.col("a") != F.col("b"))
    e = ws.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows)
    mark = _mark(e)
    while mark[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        size = None if rows is None else 2 * mark[0]
        low = ws.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low", size)
        # large star: neighbours above u move to the least of u and its neighbours
        e1 = ws.table(both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large", size)
        # small star: u and its lower neighbours move to the least of them
        low1 = ws.table(e1.groupBy("a").agg(F.min("b").alias("m")), "small-low", size)
        moved = e1.join(low1, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e2 = ws.table(moved.union(low1.select("a", "m")).distinct(), "small", size)
        ws.drop(low, low1, e1, e)
        e, before = e2, mark
        mark = _mark(e)
        if mark == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(e: DataFrame) -> tuple:
    """Number of edges and a digest of them that doesn't depend on their order."""
    r = e.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0L)"), F.expr("coalesce(sum(cast(hash(b, a) as long)), 0L)")).first()
    return tuple(r)


def component_labels(ws: Workspace, least: DataFrame, links: DataFrame) -> DataFrame:
    """``least(node, d)`` with the smallest document id of each node, ``links(a, b)`` -> ``(node, root, component_id)``.

    component_id is the smallest d of the component, root its smallest node; nodes without links have their own.
    """
    stars = connected_components(ws, links)
    root_of = stars.union(stars.select("root", "root")).distinct()
    members = ws.table(root_of.join(least, "node").select("node", "root", "d"), "members")
    first = ws.table(members.groupBy("root").agg(F.min("d").alias("c")), "first")
    group = members.join(first, "root").select("node", "root", "c")
    return ws.table(least.join(group, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("c", "d").alias("component_id")), "labels")
