"""Distances over compressed blocks.

1. Each distinct string is compressed, blown up (for the subsequence route) and cut into blocks; equal
   contents are one block wherever they occur.
2. The pairs of blocks that some pair of strings needs are formed by a join on the pair and made
   distinct, so a table is built once for all pairs of strings (the repository).
3. A pair's tables meet its block sequences, which come once a pair, and the block grid is swept, one task a pair.

Blocks follow the compressibility, but have `least` symbols where the text has so many: a table is combed
in whole anti-diagonals and applied in whole vectors, which tiny blocks would waste.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramweave.functions import grammar, seaweed, strings
from gramweave.functions.strings import kernel

SEQUENCE = "array<struct<block:string,content:array<long>>>"
#: Least symbols of a block: of the subsequence route, whose tables are permutations, and of the direct one, whose tables are dense.
LEAST, LEAST_DIRECT = 1024, 48


def _cut(direct: bool, xfactor: float, ffactor: float, least: int = 1):
    def cut(text: str) -> list[dict]:
        plain = strings.codes(text).tolist()
        if not plain:
            return []
        spelt = grammar.compressed(text)
        g = spelt if direct else grammar.blow_up(spelt)
        symbols = plain if direct else strings.blow_up_codes(np.array(plain)).tolist()
        x = max(grammar.block_length(len(symbols), g.productions(), xfactor, ffactor), min(least, len(symbols)))
        out, at = [], 0
        for _, nodes in grammar.blocks(g, x):
            size = sum(g.size[k] for k in nodes)
            content = symbols[at : at + size]
            out.append({"block": grammar.block_id(content), "content": content})
            at += size
        return out

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut(t) for t in texts], dtype=object)

    return run


def _tables(direct: bool):
    """Tables of block pairs, flattened."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        make = seaweed.distance_table_of if direct else (lambda x, y: seaweed.table_of(x, y).perm)
        return pd.Series([np.asarray(make(list(x), list(y))).ravel().tolist() for x, y in zip(a, b)], dtype=object)

    return run


def repository(sequences: DataFrame, direct: bool) -> DataFrame:
    """(a_block, b_block, cells) for distinct pairs of blocks. `sequences` has a_seq and b_seq."""
    a = sequences.select(F.explode("a_seq").alias("x"), "b_seq").select(F.col("x.block").alias("a_block"), F.col("x.content").alias("a"), "b_seq")
    both = a.dropDuplicates(["a_block", "b_seq"]).select("a_block", "a", F.explode("b_seq").alias("y"))
    pairs = both.select("a_block", "a", F.col("y.block").alias("b_block"), F.col("y.content").alias("b"))
    # the number is given, so that few pairs, each much work, stay dealt over the cores
    spark = sequences.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pairs.repartition(parts, "a_block", "b_block").dropDuplicates(["a_block", "b_block"])
    return dealt.select("a_block", "b_block", kernel(_tables(direct), "array<long>")("a", "b").alias("cells"))


def _sweep(direct: bool):
    """The distance of one pair from its block sequences and the tables of its pairs of blocks."""

    def run(shapes: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        key, rows, cols = shapes.iloc[0][["_pair", "rows", "cols"]]
        heights, widths = [int(x["n"]) for x in rows], [int(x["n"]) for x in cols]
        m, n = sum(heights), sum(widths)
        known = {(a, b): np.asarray(c, np.int64) for a, b, c in zip(tables["a_block"], tables["b_block"], tables["cells"])}

        def apply_block(i: int, j: int, border: np.ndarray) -> np.ndarray:
            table = known[rows[i]["block"], cols[j]["block"]]
            if direct:
                return seaweed.distance_applied(table.reshape(len(border), len(border)), border)
            return seaweed.applied(seaweed.Table(heights[i], widths[j], table), border)

        if direct:
            found = seaweed.sweep(heights, widths, apply_block, np.arange(m + 1), np.arange(n + 1))
        else:
            found = (m + n) // 2 - seaweed.sweep(heights, widths, apply_block, np.zeros(m + 1, np.int64), np.zeros(n + 1, np.int64))
        return pd.DataFrame({"_key": [key], "_value": [found]})

    return run


def compressed_distance(pairs: DataFrame, a: str = "a", b: str = "b", *, into: str = "distance", direct: bool = False, unit: str = "characters", xfactor: float = 1.0, ffactor: float = 1.0, least: int | None = None) -> DataFrame:
    """Add the edit distance, computed over compressed blocks. Null on a side gives null, an empty side the other's length."""
    text = strings.bytes_of if unit == "bytes" else F.col
    least = (LEAST_DIRECT if direct else LEAST) if least is None else least
    keyed = pairs.withColumn("_x", text(a)).withColumn("_y", text(b)).withColumn("_key", F.sha2(F.concat_ws("\0", F.char_length("_x").cast("string"), "_x", "_y"), 256))
    distinct = keyed.where("char_length(_x) > 0 and char_length(_y) > 0").select("_key", "_x", "_y").dropDuplicates(["_key"])
    texts = distinct.select(F.col("_x").alias("t")).union(distinct.select("_y")).distinct()
    cut = texts.withColumn("seq", kernel(_cut(direct, xfactor, ffactor, least), SEQUENCE)("t"))
    sequences = distinct.join(cut.select(F.col("t").alias("_x"), F.col("seq").alias("a_seq")), "_x").join(cut.select(F.col("t").alias("_y"), F.col("seq").alias("b_seq")), "_y")
    names = lambda c: F.array_distinct(F.transform(c, lambda s: s["block"]))
    needed = sequences.select("_key", F.explode(names("a_seq")).alias("a_block"), names("b_seq").alias("bs")).select("_key", "a_block", F.explode("bs").alias("b_block"))
    shape = lambda c: F.transform(c, lambda s: F.struct(s["block"].alias("block"), F.size(s["content"]).alias("n")))
    shapes = sequences.select(F.col("_key").alias("_pair"), shape("a_seq").alias("rows"), shape("b_seq").alias("cols"))
    tables = needed.join(repository(sequences.select("a_seq", "b_seq"), direct), ["a_block", "b_block"])
    swept = shapes.groupBy("_pair").cogroup(tables.groupBy("_key")).applyInPandas(_sweep(direct), "_key string, _value long")
    empty = F.when((F.char_length("_x") == 0) | (F.char_length("_y") == 0), F.char_length("_x") + F.char_length("_y")).cast("long")
    return keyed.join(swept, "_key", "left").select(*pairs.columns, F.coalesce("_value", empty).alias(into))
