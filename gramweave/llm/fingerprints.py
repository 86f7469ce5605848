"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: behind line ends, and within lines where a hash of the last `WINDOW` characters says so,
about every `EVERY` characters in any script, so that an edit moves no cut but those near it. Each
paragraph, with how often it came before, gives one 64-bit digest, and their sequence as a whole gives one more, which tells
texts of equal paragraphs in another order apart. A digest goes to three cells of
the sketch, one in each third, as count, XOR of digests and XOR of checks. The fingerprint is the
written sketch with the number of digests; its cells follow that number, and grow until the sketch gives back all of its
own digests, so equal texts have equal ones.

Two versions: the smaller sketch's digests are read from it and built at the larger one's size; the sketches subtract cell
by cell; cells that hold one digest are peeled until
nothing is left, which recovers exactly the digests that one has and the other lacks. If peeling
stalls, both sketches are built again twice as large. All of that needs the written fingerprints only (`likeness_of`). With d digests
recovered, likeness is (a + b - d) / (a + b + d), the Jaccard likeness of the digests.

The next document by ascending doc_id (then a hash of the text) comes without a second shuffle of
texts: documents are dealt by ranges of doc_id, and the first row of each range goes to the range
before it too. An id of many rows is dealt by ranges of the texts' hashes. Defined cases: null text is the empty text, which has no paragraph; two empty texts
are alike (1.0); a single document's next is itself; rows of equal doc_id are neighbours; null
doc_ids come first; an empty table gives no row.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._base import picked, plain, slices, stash

#: Characters of a paragraph: how many decide on a cut, how many lie between two cuts on average, how many there are at most.
WINDOW, EVERY, MOST = 6, 48, 1024
#: Ranges of doc_id at most; beyond it a range just holds more documents, which stream through a task.
RANGES = 8192
#: What stands for a null doc_id: no id is less.
NULL = -(2**63)


def cuts(text: str) -> np.ndarray:
    """Ends of the text's paragraphs, ascending; the last one is the text's."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    rolled = np.zeros(n, np.uint64)
    for back in range(min(WINDOW, n)):
        rolled[back:] += codes[: n - back] * np.uint64(pow(0x9E3779B97F4A7C15, back + 1, 1 << 64))
    ends = np.flatnonzero((codes == 10) | (_mix(rolled, 1) % np.uint64(EVERY) == 0)) + 1
    if not len(ends) or ends[-1] < n:
        ends = np.append(ends, n)
    first = np.concatenate([[0], ends[:-1]])
    if (ends - first).max() > MOST:
        ends = np.unique(np.concatenate([ends, *(np.arange(a + MOST, b, MOST) for a, b in zip(first.tolist(), ends.tolist()) if b - a > MOST)]))
    return ends


def paragraphs(text: str) -> list[str]:
    """The text's parts, which are it when joined; none is empty."""
    ends = cuts(text).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def digests(text: str) -> list[int]:
    """One digest a paragraph, all different, then one of their sequence; the n-th copy of a paragraph has its own."""
    seen: dict[int, int] = {}
    taken: dict[int, None] = {}
    parts = [xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass")) for part in paragraphs(text)]
    for part in parts:
        n = seen.get(part, 0)
        seen[part] = n + 1
        digest = xxhash.xxh3_64_intdigest(part.to_bytes(8, "little"), seed=n) if n else part
        while digest in taken:  # a sketch cannot hold a digest twice
            digest = xxhash.xxh3_64_intdigest(digest.to_bytes(8, "little"))
        taken[digest] = None
    if parts:
        digest = xxhash.xxh3_64_intdigest(np.array(parts, "<u8").tobytes(), seed=1)
        while digest in taken:
            digest = xxhash.xxh3_64_intdigest(digest.to_bytes(8, "little"))
        taken[digest] = None
    return list(taken)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def first_third(digests_held: int) -> int:
    """Cells of a third, to begin with: room for as many differing digests as the text has, and some for luck."""
    return -(-digests_held * 9 // 16) + 4


def places(keys: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Three cells of each digest, one in each third: 3 x digests. third: that of each digest's sketch."""
    size = third.astype(np.uint64)
    return np.stack([(_mix(keys, 3 + h) % size + np.uint64(h) * size).astype(np.int64) for h in range(3)])


def checks(keys: np.ndarray) -> np.ndarray:
    return _mix(keys, 0x51ED) >> np.uint64(32)


@dataclass
class Sketches:
    """Many sketches side by side: their thirds, and where each begins."""

    third: np.ndarray
    count: np.ndarray
    total: np.ndarray
    check: np.ndarray

    @property
    def start(self) -> np.ndarray:
        return 3 * (np.cumsum(self.third) - self.third)

    def put(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray | int) -> np.ndarray:
        """Add digests to their owners' sketches, or take them away; their cells."""
        at = places(keys, self.third[owner]) + self.start[owner]
        more = checks(keys)
        for row in at:
            np.add.at(self.count, row, sign)
            np.bitwise_xor.at(self.total, row, keys)
            np.bitwise_xor.at(self.check, row, more)
        return at

    def peeled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The digests that come out, their sketches, and which sketches came out empty. Empties itself."""
        of_cell = np.repeat(np.arange(len(self.third)), 3 * self.third)
        found, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        live = np.flatnonzero(self.count)
        while len(live):
            pure = live[np.abs(self.count[live]) == 1]
            pure = pure[checks(self.total[pure]) == self.check[pure]]
            if not len(pure):
                break
            # the same digest may show in several cells of its sketch: take it once
            who = of_cell[pure]
            order = np.lexsort((self.total[pure], who))
            pure, who = pure[order], who[order]
            fresh = np.append(True, (np.diff(who) != 0) | (self.total[pure][1:] != self.total[pure][:-1]))
            pure, who = pure[fresh], who[fresh]
            keys = self.total[pure].copy()
            found.append(keys)
            owners.append(who)
            live = np.unique(self.put(keys, who, -self.count[pure]))
        dirty = np.zeros(len(self.third), bool)
        dirty[of_cell[(self.count != 0) | (self.total != 0) | (self.check != 0)]] = True
        return np.concatenate(found), np.concatenate(owners), ~dirty


def sketches(keys: np.ndarray, owner: np.ndarray, third: np.ndarray, sign: np.ndarray | int = 1) -> Sketches:
    """The sketches of digests; owner: whose a digest is; third: the size of each sketch."""
    cells = 3 * int(third.sum())
    made = Sketches(third, np.zeros(cells, np.int64), np.zeros(cells, np.uint64), np.zeros(cells, np.uint64))
    made.put(keys, owner, sign)
    return made


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All digests, and whose each is."""
    return np.concatenate([*parts, np.zeros(0, np.uint64)]).astype(np.uint64), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def sizes(found: list[np.ndarray]) -> np.ndarray:
    """The third of each text's written sketch: the first size that gives back all of its digests."""
    third, todo = np.array([first_third(len(f)) for f in found], np.int64), np.arange(len(found))
    while len(todo):
        keys, owner = _joined([found[k] for k in todo])
        todo = todo[~sketches(keys, owner, third[todo]).peeled()[2]]
        third[todo] += third[todo] // 4 + 1
    return third


def differing(a: list[np.ndarray], b: list[np.ndarray], third: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair, how many digests one side has and the other lacks, and after how many larger sketches. third: that of the larger one."""
    out, tries, todo, third = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.arange(len(a)), third.copy()
    while len(todo):
        (keys, owner), (others, other) = _joined([a[k] for k in todo]), _joined([b[k] for k in todo])
        both = sketches(keys, owner, third[todo])
        both.put(others, other, -1)
        _, whose, clean = both.peeled()
        out[todo[clean]] = np.bincount(whose, minlength=len(todo))[clean]
        todo = todo[~clean]
        third[todo] *= 2
        tries[todo] += 1
    return out, tries


def _likeness(a: int | np.ndarray, b: int | np.ndarray, d: np.ndarray) -> np.ndarray:
    both = np.asarray(a + b, np.float64)
    return np.where(both > 0, (both - d) / np.maximum(both + d, 1), 1.0)


def likeness(a: list[np.ndarray], b: list[np.ndarray], third_a: np.ndarray, third_b: np.ndarray) -> np.ndarray:
    d, _ = differing(a, b, np.maximum(third_a, third_b))
    return _likeness(np.array([len(x) for x in a]), np.array([len(x) for x in b]), d)


CELL = np.dtype([("n", "<i4"), ("key", "<u8"), ("check", "<u4")])


def written(found: list[np.ndarray], third: np.ndarray) -> list[str]:
    """The fingerprints: number of digests, then count, digest and check of each cell, in base 64."""
    made = sketches(*_joined(found), third)
    cells = np.zeros(len(made.count), CELL)
    cells["n"], cells["key"], cells["check"] = made.count, made.total, made.check
    data, ends = cells.tobytes(), np.append(made.start, len(cells)) * CELL.itemsize
    return [base64.b64encode(struct.pack("<I", len(f)) + data[a:b]).decode() for f, a, b in zip(found, ends[:-1].tolist(), ends[1:].tolist())]


def read(fingerprint: str) -> tuple[np.ndarray, int]:
    """The digests of a written sketch, peeled from it, and the sketch's third."""
    data = base64.b64decode(fingerprint)
    cells = np.frombuffer(data[4:], CELL)
    third = len(cells) // 3
    keys, _, clean = Sketches(np.array([third]), cells["n"].astype(np.int64), cells["key"].astype(np.uint64), cells["check"].astype(np.uint64)).peeled()
    if not clean.all() or len(keys) != struct.unpack("<I", data[:4])[0]:
        raise ValueError("not a whole fingerprint")
    return keys, third


def likeness_of(a: str, b: str) -> float:
    """The likeness of two texts from their fingerprints alone."""
    (x, m), (y, n) = read(a), read(b)
    return float(likeness([x], [y], np.array([m]), np.array([n]))[0])


def _keys(text: str) -> np.ndarray:
    return np.array(digests(text), np.uint64)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, range, own) in order; a row that isn't its range's own only ends it."""
    held: list[tuple] = []
    last = None  # (doc_id, text, range, digests) that waits for its next

    def flush() -> pa.RecordBatch:
        nonlocal held
        names, lengths, hashes, own, edited, following = zip(*held)
        held = []
        own, edited, following = list(own), list(edited), list(following)
        each = {id(keys): keys for keys in (*own, *edited, *following)}  # most are followed by one another
        third = dict(zip(each, sizes(list(each.values())).tolist()))
        thirds = [np.array([third[id(keys)] for keys in side]) for side in (own, edited, following)]
        columns = [names, lengths, hashes, written(own, thirds[0]), written(edited, thirds[1]), likeness(own, edited, *thirds[:2]), likeness(own, following, thirds[0], thirds[2])]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=[x.split()[0] for x in OUT.split(", ")])

    for batch in slices(batches, 256):
        for doc_id, text, number, own in zip(*(batch.column(k).to_pylist() for k in range(4))):
            keys = _keys(text)
            if last is not None and last[2] == number:
                n = len(last[1])
                half = min(n // 2, len(text))
                edited = last[1][: n - n // 2] + text[:half]
                held.append((last[0], n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), last[3], _keys(edited), keys))
            last = (doc_id, text, number, keys) if own else None
        if held:
            yield flush()


def compare_with_next(docs: DataFrame, range_rows: int = 2048) -> DataFrame:
    """Fingerprints of each text and of its edited version, and their likeness to it and to the next document."""
    spark = docs.sparkSession
    named = plain(docs).withColumn("h", F.xxhash64("text"))
    # ranges of doc_id, without the texts: their edges are quantiles, several ranges a task even out
    ids = picked(docs, "doc_id").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL)).alias("key"))
    count, parts = ids.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(max(-(-count // range_rows), 8 * parts), count // 16 + 1, RANGES))
    asked = [k / ranges for k in range(1, ranges)] or [0.5]
    edges = ids.where(F.col("key") > NULL).agg(F.percentile_approx("key", asked, 16 * ranges).alias("e")).first().e or []
    # an id that would fill a range by itself is one, in parts by the texts' hashes; there are RANGES of them at most
    fill = max(range_rows, count // RANGES)
    hot = {r["key"]: -(-r["count"] // fill) for r in ids.groupBy("key").count().where(F.col("count") > fill).collect()}
    edges = np.unique(np.array([*edges, *hot, *(k + 1 for k in hot if k < 2**63 - 1)], np.int64))
    pieces = np.ones(len(edges) + 1, np.int64)
    pieces[np.searchsorted(edges, np.array(list(hot), np.int64), "right")] = list(hot.values())
    key = F.coalesce(F.col("doc_id"), F.lit(NULL))
    placed = named.withColumn("range", _range(edges, pieces)(key, F.col("h")))
    # the first row of each range: one row a range, found on ids and hashes alone
    heads = placed.groupBy("range").agg(F.min(F.struct(key.alias("k"), "h")).alias("head"))
    heads = stash(heads.select("range", "head.k", "head.h"), "heads")
    before = F.coalesce(F.lag("range").over(Window.orderBy("range")), F.last("range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select(F.col("k").alias("_k"), F.col("h").alias("_h"), before.alias("_before"))
    ends = placed.join(F.broadcast(heads), (key == F.col("_k")) & (F.col("h") == F.col("_h")))
    ends = ends.select("doc_id", "text", "h", F.col("_before").alias("range")).withColumn("own", F.lit(False))
    one = ends.dropDuplicates(["range"])
    rows = placed.select("doc_id", "text", "h", "range").withColumn("own", F.lit(True)).unionByName(one)
    ordered = rows.repartition(parts, "range").sortWithinPartitions("range", F.col("own").desc(), F.col("doc_id").asc_nulls_first(), "h")
    return ordered.select("doc_id", "text", "range", "own").mapInArrow(_compared, OUT)


def _range(edges: np.ndarray, pieces: np.ndarray):
    """Column function: the range of an id, and in a range of several pieces that of the hash, numbered in order."""
    first = np.cumsum(pieces) - pieces

    def run(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        at = np.searchsorted(edges, ids.to_numpy(np.int64), "right")
        share = hashes.to_numpy(np.int64) / 2.0**64 + 0.5
        return pd.Series((first[at] + np.minimum((share * pieces[at]).astype(np.int64), pieces[at] - 1)).astype(np.int32))

    return F.pandas_udf(run, "int")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
