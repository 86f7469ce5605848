"""Union-find as tables: components of edges, and intervals of surviving boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gramweave.operators.lineage import kept
from gramweave.sources.scratch import dropped, written

#: Points of one key that a window may order, and how many places make a word of points beyond it (a word of words has half as many).
PLAIN, FAN = 1_000_000, 4096


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, root): the least node of each one's component. `edges` has a and b, both in `nodes`.

    Each round hooks every node to the first of its neighbours and itself, in an order of hashes that is new each
    round, follows two hooks and contracts the edges, until no edge is left. The last node of a
    component in that order always goes, so it ends; in expectation a share of the nodes goes, whatever
    the order of ids along a path. A round writes two tables, its hooks and the edges left; the hooks, fewer each round,
    are followed from the nodes at the end, and stay under the lazy result.
    """
    labels = nodes.select(F.col(node).alias("v")).distinct().withColumn("rep", F.col("v"))
    left = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for end in ("a", "b"):
        left = left.join(labels.select(F.col("v").alias(end)), end, "left_semi")
    left, turn = written(left.select("a", "b"), "edges"), 0
    while not left.isEmpty():
        place = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("to"))
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min(place("b")).alias("near")).select("a", F.least("near", place("a"))["to"].alias("to"))
        jumped = written(hooks.join(hooks.select(F.col("a").alias("to"), F.col("to").alias("next")), "to").select("a", F.col("next").alias("to")), "hooks")
        labels = labels.join(jumped.select(F.col("a").alias("rep"), "to"), "rep", "left").select("v", F.coalesce("to", "rep").alias("rep"))
        ends = jumped.select("a", F.col("to").alias("ta")), jumped.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        older, left = left, written(left.join(ends[0], "a").join(ends[1], "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        dropped(older)
        turn += 1
    dropped(left)
    labels = kept(labels)
    least = labels.groupBy("rep").agg(F.min("v").alias("root"))
    return labels.join(least, "rep").select(F.col("v").alias(node), "root")


def interval_find(points: DataFrame, removed: DataFrame, place: str = "x", by: str | None = None) -> DataFrame:
    """(x, last): the last point of each point's interval. A point ends an interval unless it is in `removed`.

    Many points are cut in words of FAN places, in each of which a window finds the ends; a point without one in its word
    has the first end of a later word, which is the same question on a table of words.
    """
    keys = [by] if by else []
    gone = removed.select(F.col(place)).distinct().withColumn("_gone", F.lit(True))
    marked = points.join(gone, place, "left")
    rows = marked.select(*keys, F.col(place).alias("_x"), F.when(F.col("_gone").isNull(), F.col(place)).alias("_end"))
    return _ends(rows, keys).select(*keys, F.col("_x").alias(place), F.col("_last").alias("last"))


def _ends(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _x, _last): the first `_end` at `_x` or behind it."""
    # from the far end on: a frame that grows is one pass, one that shrinks is read anew for each row
    onward = lambda *by: F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.desc("_x")).rowsBetween(Window.unboundedPreceding, 0))
    if (rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= PLAIN:
        return rows.select(*keys, "_x", onward(*keys).alias("_last"))
    rows = kept(rows.withColumn("_word", F.floor(F.col("_x") / FAN).cast("long")))
    words = rows.groupBy(*keys, "_word").agg(F.min("_end").alias("_end"))
    # each word, and a place behind it that asks for the words to come
    asked = words.select(*keys, (2 * F.col("_word") + 1).alias("_x"), F.lit(None).cast(words.schema["_end"].dataType).alias("_end"))
    later = _ends(kept(words.select(*keys, (2 * F.col("_word")).alias("_x"), "_end").unionByName(asked)), keys)
    later = later.where(F.pmod(F.col("_x"), F.lit(2)) == 1).select(*keys, F.floor(F.col("_x") / 2).cast("long").alias("_word"), F.col("_last").alias("_later"))
    found = rows.withColumn("_own", onward(*keys, "_word")).join(later, [*keys, "_word"])
    return found.select(*keys, "_x", F.coalesce("_own", "_later").alias("_last"))


def bit_place(x) -> tuple:
    """Columns: the 64-wide word of a point, and its bit."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x / 64).cast("long"), F.pmod(x, F.lit(64)).cast("long")


def interval_words(points: DataFrame, removed: DataFrame, place: str = "x") -> DataFrame:
    """(word, bits): the surviving ends of each 64-wide word as text, the highest point first."""
    gone = removed.select(F.col(place)).distinct().withColumn("_gone", F.lit(True))
    word, bit = bit_place(place)
    marked = points.join(gone, place, "left").select(word.alias("word"), (-bit).alias("at"), F.when(F.col("_gone").isNull(), "1").otherwise("0").alias("b"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "b")))  # 64 points at most
    return marked.groupBy("word").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "").alias("bits"))
