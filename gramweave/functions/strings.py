"""Distances of two strings as columns.

Null in, null out. Characters are code points; `bytes_of` turns a column into one whose code points
are its UTF-8 bytes, which gives byte distances. Plain distances of short texts stay in the JVM; long texts, the wildcard and the subsequence
length run on Arrow batches as bit vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "*"


def kernel(run, schema: str):
    """An Arrow-batched kernel as a column function. It counts as non-deterministic, so the optimizer
    neither evaluates it twice (once for a filter inferred from an explode) nor pushes it below an
    aggregate, where it would run for every row instead of every group."""
    return F.pandas_udf(run, schema).asNondeterministic()


def bytes_of(text: Column | str) -> Column:
    """The UTF-8 bytes of a string, each as one code point."""
    return F.decode(F.encode(text, "utf-8"), "iso-8859-1")


def levenshtein(a: Column | str, b: Column | str, threshold: int | None = None) -> Column:
    """Unit-cost edit distance; with a threshold, -1 beyond it (lengths that differ more are decided by them)."""
    if threshold is None:
        return F.levenshtein(a, b).cast("long")
    apart = F.abs(F.char_length(a) - F.char_length(b)) > threshold
    return F.when(apart, F.lit(-1)).otherwise(F.levenshtein(a, b, threshold)).cast("long")


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def edit_rows(a: np.ndarray, b: np.ndarray, wildcard: int | None = None):
    """The rows of the edit-distance table, each from the one before: the least cost that an
    insertion chain can carry along the row is a running minimum."""
    index = np.arange(len(b) + 1)
    row = index.copy()
    yield row
    free = b == wildcard if wildcard is not None else None
    for k, c in enumerate(a, 1):
        cost = (b != c).astype(np.int64)
        if free is not None:
            cost[free] = 0
            if c == wildcard:
                cost[:] = 0
        best = np.append(k, np.minimum(row[:-1] + cost, row[1:] + 1))
        row = np.minimum.accumulate(best - index) + index
        yield row


def subsequence_rows(a: np.ndarray, b: np.ndarray, wildcard: int | None = None):
    """The rows of the longest-common-subsequence table: a running maximum replaces the inner loop."""
    row = np.zeros(len(b) + 1, np.int64)
    yield row
    for c in a:
        same = (b == c) | (wildcard is not None and c == wildcard)
        if wildcard is not None:
            same |= b == wildcard
        row = np.append(0, np.maximum.accumulate(np.maximum(row[1:], row[:-1] + same)))
        yield row


def _masks(pattern: np.ndarray, wildcard: int | None) -> tuple[dict[int, int], int]:
    """For each symbol the places that it matches, as the bits of one integer; what any other symbol matches."""
    place = lambda same: int.from_bytes(np.packbits(same, bitorder="little").tobytes(), "little")
    masks = {int(c): place(pattern == c) for c in np.unique(pattern)}
    if wildcard is None:
        return masks, 0
    free = masks.pop(wildcard, 0)
    masks = {c: m | free for c, m in masks.items()}
    masks[wildcard] = (1 << len(pattern)) - 1
    return masks, free


def bit_distance(a: np.ndarray, b: np.ndarray, wildcard: int | None = None) -> int:
    """Edit distance by bit vectors: a row of the table is two integers of one bit a column (the steps
    up and down along it), so a row costs a few operations on whole integers."""
    if len(a) < len(b):
        a, b = b, a
    n = len(a)
    if not len(b):
        return n
    masks, other = _masks(a, wildcard)
    full = (1 << n) - 1
    up, down, score = full, 0, n
    for c in b.tolist():
        same = masks.get(c, other)
        across = (((same & up) + up) ^ up) | same
        more = down | (full & ~(across | up))
        less = up & across
        # the last column tells how the whole distance changes
        score += (more.bit_length() == n) - (less.bit_length() == n)
        more = more << 1 | 1
        keep = same | down
        up = ((less << 1) | ~(keep | more)) & full
        down = more & keep & full
    return score


def bit_subsequence(a: np.ndarray, b: np.ndarray, wildcard: int | None = None) -> int:
    """Length of the longest common subsequence by one integer: a zero marks a column where a row steps up."""
    if len(a) < len(b):
        a, b = b, a
    masks, other = _masks(a, wildcard)
    full = (1 << len(a)) - 1
    flat = full
    for c in b.tolist():
        hit = flat & masks.get(c, other)
        flat = ((flat + hit) | (flat - hit)) & full
    return len(a) - flat.bit_count()


def plain_distance(a: str, b: str) -> int:
    return bit_distance(codes(a), codes(b))


def wildcard_distance(a: str, b: str) -> int:
    """Edit distance in which a `*` on either side matches any one character."""
    return bit_distance(codes(a), codes(b), ord(WILDCARD))


def subsequence_length(a: str, b: str, wildcard: bool = True) -> int:
    return bit_subsequence(codes(a), codes(b), ord(WILDCARD) if wildcard else None)


def subsequence_grid(a: str, b: str) -> list[list[int]]:
    """All rows of the subsequence table, one for each prefix of a."""
    return [row.tolist() for row in subsequence_rows(codes(a), codes(b), ord(WILDCARD))]


def _pairwise(measure):
    """A measure over two columns; each distinct pair of a batch runs once."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for pair in zip(a, b):
            if pair not in known:
                known[pair] = None if pair[0] is None or pair[1] is None else measure(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype=object)

    return run


#: Cells of a table from which on bit vectors beat the built-in expression, the way to Python included.
LONG_CELLS = 20_000


def lev_long(a: Column | str, b: Column | str) -> Column:
    """Edit distance that sends pairs of long texts to bit vectors and keeps the others in the JVM."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    long = F.char_length(a).cast("long") * F.char_length(b) > LONG_CELLS
    found = kernel(_pairwise(plain_distance), "long")(F.when(long, a), F.when(long, b))
    return F.coalesce(found, F.when(~long, F.levenshtein(a, b)).cast("long"))


def lev_wildcard(a: Column | str, b: Column | str) -> Column:
    return kernel(_pairwise(wildcard_distance), "long")(a, b)


def lcs_length(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common subsequence, `*` matching any one character."""
    return kernel(_pairwise(subsequence_length), "long")(a, b)


def lcs_grid(a: Column | str, b: Column | str) -> Column:
    return kernel(_pairwise(subsequence_grid), "array<array<long>>")(a, b)


def _plain_lcs(a: str, b: str) -> int:
    return subsequence_length(a, b, wildcard=False)


def indel(a: Column | str, b: Column | str) -> Column:
    """Insertions and deletions only: both lengths less twice the common subsequence."""
    lcs = kernel(_pairwise(_plain_lcs), "long")(a, b)
    return F.char_length(a).cast("long") + F.char_length(b).cast("long") - 2 * lcs


def blow_up_codes(text: np.ndarray) -> np.ndarray:
    """Every symbol followed by a sentinel that no text can hold."""
    out = np.full(2 * len(text), -1, np.int64)
    out[::2] = text
    return out


def blow_up_distance(a: str, b: str) -> int:
    """Edit distance as lengths less the common subsequence of the blown-up strings."""
    return len(a) + len(b) - bit_subsequence(blow_up_codes(codes(a)), blow_up_codes(codes(b)))


def lev_blow_up(a: Column | str, b: Column | str) -> Column:
    return kernel(_pairwise(blow_up_distance), "long")(a, b)


def lcs_native(a: Column, b: Column) -> Column:
    """The subsequence length (no wildcard) in higher-order functions, for short strings: no Python."""
    left, right = F.split(a, ""), F.split(b, "")

    def step(row: Column, c: Column) -> Column:
        start = F.struct(F.array(F.lit(0)).alias("row"), F.lit(0).alias("at"))

        def cell(state: Column, d: Column) -> Column:
            above, corner = F.get(row, state["at"] + 1), F.get(row, state["at"])
            value = F.greatest(above, F.element_at(state["row"], -1), corner + (c == d).cast("int"))
            return F.struct(F.concat(state["row"], F.array(value)).alias("row"), (state["at"] + 1).alias("at"))

        return F.aggregate(right, start, cell, lambda s: s["row"])

    first = F.transform(F.sequence(F.lit(0), F.size(right)), lambda _: F.lit(0))
    found = F.aggregate(left, first, step, lambda row: F.element_at(row, -1))
    return F.when((F.char_length(a) == 0) | (F.char_length(b) == 0), F.lit(0)).otherwise(found).cast("long")
