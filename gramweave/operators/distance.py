"""Distances of string pairs held in rows.

A row is a pair; work scales over rows. The built-in expression is the default: it stays in
whole-stage code generation and never leaves the JVM. Kernels in Python run once for each distinct pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gramweave.functions import strings
from gramweave.operators import blocks


def _engine(a: Column, b: Column, engine: str, unit: str) -> Column:
    if unit == "bytes":
        a, b = strings.bytes_of(a), strings.bytes_of(b)
    return {"builtin": strings.levenshtein, "long": strings.lev_long, "wildcard": strings.lev_wildcard, "lcs": strings.lcs_length, "indel": strings.indel, "blow_up": strings.lev_blow_up}[engine](a, b)


def distance(pairs: DataFrame, a: str = "a", b: str = "b", *, engine: str = "auto", unit: str = "characters", into: str = "distance", wildcard: bool = False) -> DataFrame:
    """Add a distance column.

    engine: auto, builtin, long (bit vectors for pairs of long texts, else builtin), wildcard, lcs, indel,
    blow_up, grammar (common subsequences over compressed blocks) or grammar_direct ((min,+) tables). auto
    is builtin, or wildcard if asked for. The grammar engines never won a measurement here: ask for them.
    Null on either side gives null; an empty side gives the other's length.
    """
    if unit not in ("characters", "bytes"):
        raise ValueError(f"unknown unit {unit}")
    if engine == "auto":
        engine = "wildcard" if wildcard else "builtin"
    if engine in ("grammar", "grammar_direct"):
        return blocks.compressed_distance(pairs, a, b, into=into, direct=engine == "grammar_direct", unit=unit)
    if engine in ("builtin", "long"):
        return pairs.withColumn(into, _engine(F.col(a), F.col(b), engine, unit))
    return over_distinct(pairs, a, b, lambda x, y: _engine(x, y, engine, unit), into)


def over_distinct(pairs: DataFrame, a: str, b: str, expression, into: str) -> DataFrame:
    """Evaluate an expensive expression once for each distinct pair and join the results back; columns may have any names."""
    names = [f"_{k}" for k in range(len(pairs.columns))]
    x, y = (F.col(names[pairs.columns.index(c)]) for c in (a, b))
    rows = pairs.toDF(*names)
    known = rows.select(x.alias("u"), y.alias("v")).distinct().withColumn("value", expression(F.col("u"), F.col("v"))).withColumn("of", F.xxhash64("u", "v"))
    joined = rows.withColumn("key", F.xxhash64(x, y)).join(known, (F.col("key") == F.col("of")) & x.eqNullSafe(F.col("u")) & y.eqNullSafe(F.col("v")), "left")
    return joined.select(*names, "value").toDF(*pairs.columns, into)


def within(pairs: DataFrame, k: int, a: str = "a", b: str = "b", into: str = "distance") -> DataFrame:
    """Pairs of a distance up to k: lengths decide first, then a bounded expression."""
    near = pairs.where(F.abs(F.char_length(a) - F.char_length(b)) <= k)
    return near.withColumn(into, strings.levenshtein(F.col(a), F.col(b), k)).where(F.col(into) >= 0)


def within_blocks(rows: DataFrame, key: Column, text: str, row_id: str, k: int) -> DataFrame:
    """Pairs of rows with one blocking key whose texts differ by k edits at most: (id_a, id_b, distance).

    The key joins; equal lengths and neighbours up to k sort within it by an equi-join on the length
    bucket, so rows of one key but far lengths never meet.
    """
    sized = rows.select(key.alias("_key"), F.col(row_id).alias("_id"), F.col(text).alias("_text"), F.floor(F.char_length(text) / (k + 1)).alias("_at"))
    left = sized.select("_key", F.col("_id").alias("id_a"), F.col("_text").alias("_a"), F.explode(F.array(F.col("_at") - 1, F.col("_at"), F.col("_at") + 1)).alias("_at"))
    right = sized.select("_key", F.col("_id").alias("id_b"), F.col("_text").alias("_b"), "_at")
    pairs = left.join(right, ["_key", "_at"]).where("id_a < id_b")
    return within(pairs, k, "_a", "_b").select("id_a", "id_b", "distance")


def nearest(pairs: DataFrame, group: list[str], k: int, a: str = "a", b: str = "b", ties: list[str] | None = None) -> DataFrame:
    """The k nearest partners of each group with their rank; ties by the named columns."""
    ranked = pairs.withColumn("distance", strings.levenshtein(F.col(a), F.col(b)))
    order = Window.partitionBy(*group).orderBy("distance", *(ties or [b]))
    return ranked.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def grid_cells(pairs: DataFrame, keep: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """The subsequence table of each pair as cells (i, j, v)."""
    rows = pairs.select(*keep, F.posexplode(strings.lcs_grid(F.col(a), F.col(b))).alias("i", "_row"))
    return rows.select(*keep, F.col("i").cast("long").alias("i"), F.posexplode("_row").alias("j", "v")).select(*keep, "i", F.col("j").cast("long").alias("j"), "v")
