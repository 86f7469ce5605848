"""Grammars that all texts share: productions as rows named by a digest of what they derive.

A text is halved again and again, the first half being the longer one, and equal parts are one production wherever they
occur: in a text, in another one, at another depth. Each round takes the different parts of the one before, so what repeats is
cut once. On these productions work access to any range of a text, and a repository of boundary tables, one for each
two productions that some pair of texts needs, filled level by level.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramweave.functions import seaweed
from gramweave.functions.strings import codes, kernel
from gramweave.operators import tables
from gramweave.sources.scratch import dropped, written

#: Cells of two productions up to which their table is combed rather than put together.
LEAF = 1 << 24


def node_of(content: Column | str) -> Column:
    """The name of the production that derives a text."""
    return F.unhex(F.sha2(content, 256))


def productions(texts: DataFrame, text: str = "text", leaf: int = 1) -> DataFrame:
    """(node, size, left, right, left_size, left_symbol, right_symbol, content): each different part of the texts once.

    A part of `leaf` characters at most has no halves; such a half has its symbols with the pair, so that none needs to look it up.
    Every range of texts can be read whatever the leaves are; all parts, down to single characters, are there with leaves of one.
    Null and empty texts have no production. The result is a written table.
    """
    rounds = [written(texts.where(F.char_length(text) > 0).select(F.col(text).alias("content")).distinct(), "parts")]
    while not (pairs := rounds[-1].where(F.char_length("content") > leaf)).isEmpty():
        halves = F.array(F.substring("content", F.lit(1), _half("content")), F.expr("substring(content, (char_length(content) + 1) div 2 + 1)"))
        below = pairs.select(F.explode(halves).alias("content"))
        # leaves larger than a character are read from the pair that has them
        rounds.append(written((below if leaf == 1 else below.where(F.char_length("content") > leaf)).distinct(), "parts"))
    parts = reduce(DataFrame.unionByName, rounds).distinct()
    size, half = F.char_length("content").cast("long"), _half("content").cast("long")
    first, rest = F.substring("content", F.lit(1), _half("content")), F.expr("substring(content, (char_length(content) + 1) div 2 + 1)")
    pair = lambda c: F.when(size > leaf, c)
    found = written(parts.select(node_of("content").alias("node"), size.alias("size"), pair(node_of(first)).alias("left"), pair(node_of(rest)).alias("right"), pair(half).alias("left_size"), F.when((size > leaf) & (half <= leaf), first).alias("left_symbol"), F.when((size > leaf) & (size - half <= leaf), rest).alias("right_symbol"), "content"), "productions")
    dropped(*rounds)
    return found


def _half(content: str) -> Column:
    return F.floor((F.char_length(content) + 1) / 2).cast("int")


def extract(asked: DataFrame, grammar: DataFrame, key: str = "id") -> DataFrame:
    """(key, text): the characters from `begin` on and before `end` of what `node` derives, for each row asked.

    Rows (node, begin, end) go down the productions together; what lies outside of a range is never visited. An empty range, one
    without a node, or one beyond the text gives what there is of it, at least the empty text.
    """
    whole = asked.select(F.col(key).alias("_key"), "node", F.greatest(F.lit(0), "begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))
    sized = grammar.select("node", "size", "left", "right", "left_size", "left_symbol", "right_symbol", F.when(F.col("left").isNull(), F.col("content")).alias("symbol"))
    going = written(whole.where("node IS NOT NULL AND begin < end").select("_key", "node", "begin", "end", F.lit(0).cast("long").alias("at")), "ranges")
    found = []
    ends = F.col("left_size")
    step = "struct<node:binary,symbol:string,begin:bigint,end:bigint,at:bigint>"
    while not going.isEmpty():
        met = going.join(sized, "node")
        own = F.struct(F.lit(None).cast("binary").alias("node"), F.col("symbol").alias("symbol"), "begin", "end", "at").cast(step)
        first = F.struct(F.when(F.col("left_symbol").isNull(), F.col("left")).alias("node"), F.col("left_symbol").alias("symbol"), F.col("begin"), F.least("end", ends).alias("end"), F.col("at")).cast(step)
        after = F.greatest(F.col("begin") - ends, F.lit(0))
        rest = F.struct(F.when(F.col("right_symbol").isNull(), F.col("right")).alias("node"), F.col("right_symbol").alias("symbol"), after.alias("begin"), (F.least("end", "size") - ends).alias("end"), (F.col("at") + F.greatest(ends - F.col("begin"), F.lit(0))).alias("at")).cast(step)
        children = F.when(F.col("left").isNull(), F.when(F.col("begin") < F.col("size"), F.array(own)).otherwise(F.array().cast(f"array<{step}>"))).otherwise(F.concat(*[F.when(wanted, F.array(child)).otherwise(F.array().cast(f"array<{step}>")) for child, wanted in ((first, F.col("begin") < ends), (rest, (F.col("end") > ends) & (F.col("begin") < F.col("size"))))]))
        below = written(met.select("_key", F.explode(children).alias("x")).select("_key", "x.*"), "ranges")
        found.append(below.where("symbol IS NOT NULL").select("_key", "at", F.substring("symbol", (F.col("begin") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int")).alias("symbol")))
        going = below.where("symbol IS NULL").select("_key", "node", "begin", "end", "at")
    spelt = reduce(DataFrame.unionByName, found) if found else going.select("_key", "at", F.lit("").alias("symbol"))
    texts = spelt.groupBy("_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda x: x["symbol"]), "").alias("text"))
    return whole.select("_key").distinct().join(texts, "_key", "left").select(F.col("_key").alias(key), F.coalesce("text", F.lit("")).alias("text"))


def _combed(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([tables._struct(seaweed.combed(codes(x).astype(np.int64), codes(y).astype(np.int64))) for x, y in zip(a, b, strict=True)], columns=["rows", "cols", "perm"])


def _merged(vertical: pd.Series, first: pd.DataFrame, second: pd.DataFrame) -> pd.DataFrame:
    merge = lambda v, x, y: (seaweed.stacked if v else seaweed.beside)(tables._read(x), tables._read(y))
    return pd.DataFrame([tables._struct(merge(v, x, y)) for v, x, y in zip(vertical, first.to_dict("records"), second.to_dict("records"), strict=True)], columns=["rows", "cols", "perm"])


def repository(asked: DataFrame, grammar: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(p, q, table): the boundary table of each two productions that the rows (p, q) ask for, and of all that these consist of.

    Downwards, a pair of more than `leaf` cells has its longer side halved, and each different pair is kept once, whoever asked for it.
    Upwards, tables of leaves are combed, and a pair whose two parts are there is merged from them, level by level. `leaf` changes
    no table. The result is a written table.
    """
    side = lambda c, columns: grammar.select(F.col("node").alias(c), *[F.col(name).alias(f"{c}_{name}") for name in columns])
    known = []
    going = written(asked.select("p", "q").where("p IS NOT NULL AND q IS NOT NULL").distinct(), "pairs")
    while not going.isEmpty():
        met = going.join(side("p", ["size", "left", "right"]), "p").join(side("q", ["size", "left", "right"]), "q")
        vertical, divided = F.col("p_size") >= F.col("q_size"), F.col("p_size") * F.col("q_size") > leaf
        part = lambda end: F.when(divided, F.struct(F.when(vertical, F.col(f"p_{end}")).otherwise(F.col("p")).alias("p"), F.when(vertical, F.col("q")).otherwise(F.col(f"q_{end}")).alias("q")))  # noqa: E731, B023
        level = written(met.select("p", "q", vertical.alias("vertical"), part("left").alias("first"), part("right").alias("second")), "pairs")
        dropped(going)
        known.append(level)
        seen = reduce(DataFrame.unionByName, [k.select("p", "q") for k in known])
        below = level.where("first IS NOT NULL").select(F.explode(F.array("first", "second")).alias("x")).select("x.p", "x.q").distinct()
        going = written(below.join(seen, ["p", "q"], "left_anti"), "pairs")
    if not known:
        return going.select("p", "q", F.lit(None).cast(tables.TABLE).alias("table"))
    dropped(going)
    pairs = reduce(DataFrame.unionByName, known)
    combed = pairs.where("first IS NULL").join(side("p", ["content"]), "p").join(side("q", ["content"]), "q")
    parts = _parts(asked)
    # the number is given, so that few pairs, each much work, stay dealt over the cores
    built = [written(combed.repartition(parts, "p", "q").select("p", "q", kernel(_combed, tables.TABLE)("p_content", "q_content").alias("table")), "tables")]
    waiting = written(pairs.where("first IS NOT NULL"), "waiting")
    while not waiting.isEmpty():
        there = reduce(DataFrame.unionByName, built)
        of = lambda c: there.select(F.struct("p", "q").alias(c), F.col("table").alias(f"{c}_table"))  # noqa: E731, B023
        ready = waiting.join(of("first"), "first").join(of("second"), "second")
        built.append(written(ready.repartition(parts, "p", "q").select("p", "q", kernel(_merged, tables.TABLE)("vertical", "first_table", "second_table").alias("table")), "tables"))
        older, waiting = waiting, written(waiting.join(built[-1].select("p", "q"), ["p", "q"], "left_anti"), "waiting")
        dropped(older)
    dropped(waiting, *known)
    return reduce(DataFrame.unionByName, built)


def _parts(rows: DataFrame) -> int:
    spark = rows.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
