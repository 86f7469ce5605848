"""Distances of pairs too long for one task: the table's blocks are rows that advance by anti-diagonals.

A block gets what crosses its left side (bit vectors, one bit a symbol of `a`) and its upper side (a step for each symbol of
`b`) and gives the same to its right and lower neighbour. Both move with the text of their side, so an anti-diagonal is one shuffle by block, whose
tasks are its blocks; every few diagonals the borders are written, which is all that a lost executor can cost. Borders are in
proportion to the strings, whatever the number of cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramweave.functions.strings import bytes_of, codes
from gramweave.sources.scratch import dropped, written

#: Symbols of a block's side, at least and at most, where its size isn't given; diagonals from one written table to the next.
LEAST, MOST, EVERY = 4096, 1 << 20, 4
#: Symbols of a side up to which a task takes many blocks at once, rather than a group each.
SMALL = 1024
STATE = "i int, j int, last_i int, last_j int, side string, text string, state binary, score long"


def _int(data: bytes | None, default: int) -> int:
    return default if data is None else int.from_bytes(data, "little")


def _bytes(value: int, bits: int) -> bytes:
    return value.to_bytes((bits + 7) // 8, "little")


def _masks(a: np.ndarray) -> dict[int, int]:
    return {int(c): int.from_bytes(np.packbits(a == c, bitorder="little").tobytes(), "little") for c in np.unique(a)}


def distance_block(a: np.ndarray, b: np.ndarray, left: bytes | None, above: bytes | None) -> tuple[bytes, bytes, int]:
    """A block of the edit distance: steps up and down along its right side, steps along its lower side, and the change along the right side.

    Without a border the side lies on the edge of the table, where each symbol is a step up.
    """
    m = len(a)
    full, top, half = (1 << m) - 1, m - 1, (m + 7) // 8
    up = full if left is None else _int(left[:half], 0)
    down = 0 if left is None else _int(left[half:], 0)
    masks = _masks(a)
    steps = [1] * len(b) if above is None else np.frombuffer(above, np.int8).tolist()
    below = []
    for c, step in zip(b.tolist(), steps, strict=True):
        same = masks.get(c, 0)
        held = same | down
        if step < 0:
            same |= 1
        across = (((same & up) + up) ^ up) | same
        more = down | (full & ~(across | up))
        less = up & across & full
        below.append((more >> top & 1) - (less >> top & 1))
        more = (more << 1 | (step > 0)) & full
        less = (less << 1 | (step < 0)) & full
        up = less | (full & ~(held | more))
        down = more & held
    return _bytes(up, m) + _bytes(down, m), np.array(below, np.int8).tobytes(), up.bit_count() - down.bit_count()


def subsequence_block(a: np.ndarray, b: np.ndarray, left: bytes | None, above: bytes | None) -> tuple[bytes, bytes, int]:
    """The same of the longest common subsequence: bits where a symbol of `a` is no step, and carries from one block's sum to the next."""
    m = len(a)
    full = (1 << m) - 1
    flat, masks = _int(left, full), _masks(a)
    carries = [0] * len(b) if above is None else np.frombuffer(above, np.int8).tolist()
    below = []
    for c, carry in zip(b.tolist(), carries, strict=True):
        hit = flat & masks.get(c, 0)
        total = flat + hit + carry
        below.append(total >> m)
        flat = (total | (flat & ~hit)) & full
    return _bytes(flat, m), np.array(below, np.int8).tobytes(), m - flat.bit_count()


BLOCKS = {"distance": distance_block, "subsequence": subsequence_block}


def _moved(kind: str, v: dict, h: dict) -> list[dict]:
    """What a block gives to its neighbours, from the rows of its left and its upper side."""
    right, below, change = BLOCKS[kind](codes(v["text"]), codes(h["text"]), v["state"], h["state"])
    out, last_row, last_column = [], v["i"] == v["last_i"], v["j"] == v["last_j"]
    if not last_column:
        out.append(v | {"j": v["j"] + 1, "state": right})
    else:  # down the last column goes the sum of what the rows above changed
        h["score"] += change
    if not last_row:
        out.append(h | {"i": h["i"] + 1, "state": below})
    elif last_column:
        out.append(h | {"side": "end", "text": None, "state": None})
    return out


def _advance(kind: str):
    def run(table: pa.Table) -> pa.Table:
        rows = {r["side"]: r for r in table.to_pylist()}
        return table if "end" in rows else pa.Table.from_pylist(_moved(kind, rows["v"], rows["h"]), table.schema)

    return run


def _advance_sorted(kind: str):
    """The same of many small blocks, whose rows stand one behind the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["side"] == "end":
                    out.append(row)
                elif waiting is None:
                    waiting = row
                else:
                    v, h = (row, waiting) if row["side"] == "v" else (waiting, row)
                    if (v["id"], v["i"], v["j"], h["side"]) != (h["id"], h["i"], h["j"], "h"):
                        raise ValueError("a block has one left and one upper side")
                    out += _moved(kind, v, h)
                    waiting = None
            yield pa.RecordBatch.from_pylist(out, batch.schema)

    return run


def wavefront(pairs: DataFrame, a: str = "a", b: str = "b", *, kind: str = "distance", into: str = "distance", unit: str = "characters", size: int | None = None, every: int = EVERY) -> DataFrame:
    """Add the edit distance (or, of kind `subsequence`, the length of the longest common subsequence) of long pairs.

    Null on a side gives null, an empty side the other's length (or 0). `size` is the number of symbols of a block's side; by default the longest
    text has a few blocks a core, so that a diagonal of one pair occupies all of them. Tables are left under the lazy result.
    """
    spark = pairs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    text = bytes_of if unit == "bytes" else F.col
    keyed = pairs.withColumn("_x", text(a)).withColumn("_y", text(b)).withColumn("_key", F.sha2(F.concat_ws("\0", F.char_length("_x").cast("string"), "_x", "_y"), 256))
    distinct = keyed.where("char_length(_x) > 0 AND char_length(_y) > 0").select(F.col("_key").alias("id"), F.col("_x").alias("a"), F.col("_y").alias("b")).dropDuplicates(["id"])
    if size is None:
        longest = distinct.agg(F.max(F.greatest(F.char_length("a"), F.char_length("b")))).first()[0] or 1
        size = min(MOST, max(LEAST, -(-longest // (2 * cores))))
    last = lambda c: F.floor((F.char_length(c) - 1) / size).cast("int")
    sized = distinct.select("id", "a", "b", last("a").alias("last_i"), last("b").alias("last_j"))

    def side(name: str, text: str, at: str, end: str):
        rows = sized.select("id", "last_i", "last_j", text, F.explode(F.sequence(F.lit(0), F.col(end))).alias(at))
        score = F.lit(0) if kind != "distance" or name == "v" else F.when(F.col("j") == F.col("last_j"), F.col("last_j") * size + F.char_length("text")).otherwise(0)
        cut = rows.withColumn("text", F.substring(text, F.col(at) * size + 1, F.lit(size))).withColumn("j" if at == "i" else "i", F.lit(0))
        return cut.select("id", "i", "j", "last_i", "last_j", F.lit(name).alias("side"), "text", F.lit(None).cast("binary").alias("state"), score.cast("long").alias("score"))

    starts = written(side("v", "a", "i", "last_i").unionByName(side("h", "b", "j", "last_j")), "edges")
    diagonals = (starts.agg(F.max(F.col("last_i") + F.col("last_j"))).first()[0] or 0) + 1
    parts = max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    state = None
    older = None
    for d in range(diagonals):
        begun = starts.where(F.col("i") + F.col("j") == d)
        rows = begun if state is None else state.unionByName(begun)
        # the number of parts is given: few small rows are much work
        dealt = rows.repartition(parts, "id", "i", "j")
        if size <= SMALL:
            state = dealt.sortWithinPartitions("id", "i", "j").mapInArrow(_advance_sorted(kind), f"id string, {STATE}")
        else:
            state = dealt.groupBy("id", "i", "j").applyInArrow(_advance(kind), f"id string, {STATE}")
        if (d + 1) % every == 0:
            state = written(state, "borders")
            if older is not None:
                dropped(older)
            older = state
    ends = state.where("side = 'end'").select(F.col("id").alias("_key"), F.col("score").alias("_value"))
    empty = F.when((F.char_length("_x") == 0) | (F.char_length("_y") == 0), F.char_length("_x") + F.char_length("_y") if kind == "distance" else F.lit(0)).cast("long")
    return keyed.join(ends, "_key", "left").select(*pairs.columns, F.coalesce("_value", empty).alias(into))
