"""Connected components by contraction, in tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import drop_stash, stash


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest node that each node of `edges` (a, b) is connected with.

    Each round hooks every node to its least neighbour, follows two hooks and contracts the edges;
    a round at least halves the nodes that still have edges. Nothing is collected.
    """
    left = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while labels is None or not left.isEmpty():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("to"))
        hooks = stash(hooks, "hooks")
        again = hooks.select(F.col("id").alias("to"), F.col("to").alias("next"))
        jumped = stash(hooks.join(again, "to").select("id", F.col("next").alias("to")), "hooks")
        if labels is None:
            labels = stash(jumped.select("id", F.col("to").alias("root")), "labels")
        else:
            older = labels
            labels = stash(older.join(jumped.select(F.col("id").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root")), "labels")
            drop_stash(older)
        ends = jumped.select(F.col("id").alias("a"), F.col("to").alias("ta")), jumped.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        moved = left.join(ends[0], "a").join(ends[1], "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        moved = stash(moved, "edges")
        drop_stash(left, hooks, jumped)
        left = moved
    drop_stash(left)
    return labels
