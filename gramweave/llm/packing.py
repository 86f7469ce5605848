"""Best-fit packing of token sequences, large items by matching.

The plan needs only how many pieces there are of each length, a table of at most `capacity` rows
whatever the corpus: pieces above one third of the capacity can share a bin with one other of
their kind at most, so they are matched greedily (the longest with the longest that still fits);
the smaller ones then go, longest first, to the fullest bin that takes them. Bins alike are
planned as one pattern with a multiplicity, so the plan has a few rows for each length. Pieces
find their place by their rank among the pieces of their length: the count of that length in
earlier partitions plus a running number, which needs no shuffle of pieces.

Defined cases: null or empty text is one piece holding the end id; only documents longer than the
capacity are cut; rows of equal or null doc_id are packed as separate documents; an empty table
gives no row.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gramweave.operators.spread import spread

from ._base import bounded, plain, slices, stash
from .tokenizer_units import encoder

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

#: A pattern of bins: (length, copies) from the first place on, and how many bins are alike.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def plan_bins(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Bins for counts of lengths: greedy matching above a third, best fit below."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must lie in 1..capacity")
    large = sorted(n for n in left if 3 * n > capacity)
    open_bins: dict[int, list[Pattern]] = defaultdict(list)  # by gap
    gaps: list[int] = []

    def keep(items: tuple[tuple[int, int], ...], bins: int) -> None:
        gap = capacity - sum(n * k for n, k in items)
        if not open_bins[gap]:
            insort(gaps, gap)
        open_bins[gap].append((items, bins))

    while large:
        longest = large[-1]
        at = bisect_left(large, capacity - longest + 1) - 1  # the longest partner that fits
        if at < 0:
            keep(((longest, 1),), left[longest])
            large.pop()
            continue
        partner = large[at]
        if partner == longest:
            if left[longest] >= 2:
                keep(((longest, 2),), left[longest] // 2)
            left[longest] %= 2
            if left[longest]:  # the odd one takes the next shorter
                partner = large[at - 1] if at else 0
                keep(((longest, 1), (partner, 1)) if partner else ((longest, 1),), 1)
                if partner:
                    left[partner] -= 1
            large.pop()
        else:
            bins = min(left[longest], left[partner])
            keep(((longest, 1), (partner, 1)), bins)
            left[longest] -= bins
            left[partner] -= bins
            if not left[longest]:
                large.pop()
        if partner != longest and partner and not left[partner]:
            large.remove(partner)

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            at = bisect_left(gaps, n)
            if at < len(gaps):
                gap = gaps[at]
                items, bins = open_bins[gap].pop()
                if not open_bins[gap]:
                    gaps.pop(at)
            else:
                gap, items, bins = capacity, (), todo  # new bins, as many as needed
            each = gap // n  # the bin stays the fullest that fits until it is full for this length
            full = min(bins, todo // each)
            rest = todo - full * each if full < bins else 0
            rest = rest if rest < each else 0
            todo -= full * each + rest
            if full:
                keep((*items, (n, each)), full)
            if rest:
                keep((*items, (n, rest)), 1)
            if items and (same := bins - full - (rest > 0)):
                keep(items, same)
    return [pattern for gap in sorted(open_bins) for pattern in open_bins[gap]]


def place_table(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies a bin, first offset), by length and rank."""
    rows, used, sequence = [], Counter(), 0
    for items, bins in patterns:
        offset = 0
        for n, copies in items:
            rows.append((n, used[n], sequence, copies, offset))
            used[n] += copies * bins
            offset += n * copies
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _pieces(path: str, words: bool, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(path, words), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], enc.dtype).tobytes()
        step = capacity * enc.width
        for batch in slices(batches):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "nth")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.encode(text) + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    cut = np.frombuffer(ids[at : at + step], enc.dtype)
                    for k, v in zip(out, (doc_id, piece, piece * capacity, len(cut), zlib.crc32(cut.astype("<u4")), seen[len(cut)])):
                        out[k].append(v)
                    seen[len(cut)] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            columns = {k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds)}
            columns["part"] = pa.array([part] * len(out["nth"]), pa.int32())
            yield pa.RecordBatch.from_pydict({k: columns[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")})

    return run


def _placed(table: np.ndarray):
    keys = table[:, 0] << 48 | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            row = table[np.searchsorted(keys, n << 48 | rank, "right") - 1]
            nth = rank - row[:, 1]
            kept = [batch.column(k) for k in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n), batch.column(4), pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * n)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, *, words: bool = True, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Per piece of the tokenized documents: its ids' digest and its place in a sequence of at most `capacity` tokens."""
    pieces = stash(plain(docs).mapInArrow(_pieces(tokenizer, words, end_id, capacity), PIECES), "pieces")
    tally = pieces.groupBy("part", "length").agg(F.max("nth").alias("last"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tally = stash(tally.select("part", "length", (F.col("last") + 1).alias("n"), F.coalesce(F.sum(F.col("last") + 1).over(earlier), F.lit(0)).alias("base")), "tally")
    # bounded by the capacity: one row a length
    counts = {r.length: r.n for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = place_table(plan_bins(counts, capacity))
    ranked = pieces.join(bounded(tally, 64), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_placed(table), PLACED)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return pack(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), path("word_bpe_49k.json"))
