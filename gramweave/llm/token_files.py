"""Token-ID output: document boundaries as Elias-Fano codes over one concatenated id array.

The corpus becomes one long array of ids in ascending doc_id order, cut into segments of bounded
size. A segment is one self-contained binary record of the format below, kept in the `record`
column of a Parquet table, so that Spark's commit protocol covers the loss of executors and no
executor needs a local file:

    4s magic, B id width, H 0, Q documents, Q ids, Q null doc_ids, q first doc_id,
    Elias-Fano of the boundaries, Elias-Fano of the doc_ids less the first one, ids (little-endian)

    Elias-Fano: B low bits, Q high bytes, Q low bytes, Q samples; high bits in unary; low bits packed;
    one sampled position (32 bits) per 256 ones

Document i begins at select1(i) on the high bits joined with its low bits, about 2 + log2(ids / documents)
bits a document; doc_ids ascend, so they take the same code. There is no table of 64-bit numbers. Reading a file
selects the boundaries of a record from its bytes' counts of ones; `fetch` finds single documents by binary search
over selected doc_ids and two selects, each from its sample on.

Defined cases: null text is the empty text (only the end id); documents of equal doc_id are
ordered by a hash of the text; null doc_ids come first; an empty table gives no segment.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._base import plain, scratch_path, slices
from .tokenizer_units import encoder

MAGIC = b"EFT2"
HEAD, PART = struct.Struct("<4sBHQQQq"), struct.Struct("<BQQQ")
SAMPLE = 256
SEGMENTS = "part int, segment int, n_docs long, n_ids long, first_id long, last_id long, record binary"

#: By byte: how many ones it has, and where the k-th of them is.
ONES = np.array([b.bit_count() for b in range(256)])
PLACES = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[:8] for b in range(256)])


class EliasFano:
    """A read code of a monotone sequence of unsigned numbers."""

    def __init__(self, record: bytes, at: int = 0):
        self.low_bits, high, low, samples = PART.unpack_from(record, at)
        at += PART.size
        self.high = np.frombuffer(record, np.uint8, high, at)
        self.low = np.frombuffer(record, np.uint8, low, at + high)
        self.samples = np.frombuffer(record, "<u4", samples, at + high + low)
        self.end = at + high + low + 4 * samples

    def select(self, i: int) -> int:
        """Number i, from its sample on."""
        bit, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = bit >> 3
        word = int(self.high[byte]) >> (bit & 7) << (bit & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        value = 0
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            value |= (int(self.low[at >> 3]) >> (at & 7) & 1) << k
        return ((byte << 3) + int(PLACES[word, left]) - i) << self.low_bits | value

    def selects(self, n: int) -> np.ndarray:
        """The first n numbers, by the counts of ones of the bytes in front."""
        i = np.arange(n)
        upto = np.cumsum(ONES[self.high])
        byte = np.searchsorted(upto, i, "right")
        own = self.high[byte]
        ones = (byte << 3) + PLACES[own, i - upto[byte] + ONES[own]]
        lows = np.unpackbits(self.low, bitorder="little")[: n * self.low_bits].reshape(n, self.low_bits)
        packed = np.zeros(n, np.uint64)
        for k in range(self.low_bits):
            packed |= lows[:, k].astype(np.uint64) << np.uint64(k)
        return (ones - i).astype(np.uint64) << np.uint64(self.low_bits) | packed


def ef_encode(values: np.ndarray) -> bytes:
    """The code of a monotone sequence of unsigned numbers."""
    n, universe = len(values), int(values[-1]) if len(values) else 0
    low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
    values = values.astype(np.uint64)
    ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    unary = np.zeros((universe >> low_bits) + n + 1, np.uint8)
    unary[ones] = 1
    lows = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    high, low, samples = np.packbits(unary, bitorder="little").tobytes(), np.packbits(lows.ravel(), bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4")
    return PART.pack(low_bits, len(high), len(low), len(samples)) + high + low + samples.tobytes()


class Segment:
    """A read record: boundaries and doc_ids by select, ids by slice."""

    def __init__(self, record: bytes):
        magic, self.width, _, self.n_docs, self.n_ids, self.nulls, self.first = HEAD.unpack_from(record)
        if magic != MAGIC:
            raise ValueError("not a token record")
        self.ends = EliasFano(record, HEAD.size)
        self.names = EliasFano(record, self.ends.end)
        self.ids = np.frombuffer(record, f"<u{self.width}", self.n_ids, self.names.end)

    def bounds(self) -> np.ndarray:
        """All n_docs + 1 boundaries at once."""
        return self.ends.selects(self.n_docs + 1).astype(np.int64)

    def doc_ids(self) -> list[int | None]:
        known = self.names.selects(self.n_docs - self.nulls) + np.array([self.first]).view(np.uint64)
        return [None] * self.nulls + known.view(np.int64).tolist()

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i) : self.ends.select(i + 1)]

    def find(self, doc_id: int) -> range:
        """The places of documents of an id."""
        places = range(self.n_docs - self.nulls)
        known = lambda k: self.names.select(k) + self.first
        return range(self.nulls + bisect_left(places, doc_id, key=known), self.nulls + bisect_right(places, doc_id, key=known))


def pack_segment(names: list[int | None], ids: list[bytes], width: int) -> bytes:
    """The record of some documents' ids. doc_ids ascend, nulls first."""
    ends = np.concatenate([[0], np.cumsum([len(x) // width for x in ids])])
    known = np.array([x for x in names if x is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    apart = known.view(np.uint64) - np.array([first]).view(np.uint64)
    return HEAD.pack(MAGIC, width, 0, len(ids), int(ends[-1]), len(names) - len(known), first) + ef_encode(ends) + ef_encode(apart) + b"".join(ids)


def _segments(path: str, words: bool, end_id: int, most_ids: int, most_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number = encoder(path, words), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.dtype).tobytes()
        names, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal names, held, size, number
            known = [x for x in names if x is not None] or [None]
            row = {"part": [part], "segment": [number], "n_docs": [len(held)], "n_ids": [size], "first_id": [known[0]], "last_id": [known[-1]], "record": [pack_segment(names, held, enc.width)]}
            out = pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("record", pa.binary())]))
            names, held, size, number = [], [], 0, number + 1
            return out

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.encode(text) + end
                names.append(doc_id)
                held.append(ids)
                size += len(ids) // enc.width
                if size >= most_ids or len(held) >= most_docs:
                    yield flush()
        if held:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, words: bool = False, end_id: int = 0, most_ids: int = 1 << 19, most_docs: int = 1 << 14) -> str:
    """Encode every text and write the records under `path`, parts and segments in ascending doc_id order.

    One shuffle: the texts are range-partitioned by doc_id (a hash of the text splits runs of equal
    doc_ids) and sorted within the partition; tokenizing and packing stream over it.
    """
    hashed = F.xxhash64("text")
    placed = plain(docs).repartitionByRange(F.col("doc_id"), hashed).sortWithinPartitions(F.col("doc_id"), hashed)
    placed.mapInArrow(_segments(tokenizer, words, end_id, most_ids, most_docs), SEGMENTS).write.option("compression", "zstd").parquet(path)
    return path


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with `start`, the ids before each of them. The only unpartitioned window is over one row a part."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    sizes = segments.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = parts.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("inside", inside).join(before, "part").select("part", "segment", (F.col("base") + F.col("inside")).alias("base"))


def _documents(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4):
            for part, number, record in zip(*(batch.column(k).to_pylist() for k in range(3))):
                seg = Segment(record)
                bounds, doc_ids = seg.bounds(), seg.doc_ids()
                wide = memoryview(seg.ids.astype("<u4")).cast("B")
                cut = bounds.tolist()
                n = len(doc_ids)
                out = {
                    "part": pa.array([part] * n, pa.int32()), "segment": pa.array([number] * n, pa.int32()), "doc_id": pa.array(doc_ids, pa.int64()), "inside": pa.array(bounds[:-1]),
                    "n_tokens": pa.array(np.diff(bounds)), "ids_crc32": pa.array([zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(cut, cut[1:])], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([seg.ids[a:b].astype(np.int64) for a, b in zip(cut, cut[1:])], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids."""
    schema = "part int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = spark.read.schema(SEGMENTS).parquet(path).select("part", "segment", "record").mapInArrow(_documents(with_ids), schema)
    more = ["ids"] if with_ids else []
    return rows.join(read_segments(spark, path), ["part", "segment"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *more)


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents of some doc_ids: records whose range holds none are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4):
            found = [(name, seg.document(k).astype(np.int64)) for seg in map(Segment, batch.column(0).to_pylist()) for name in wanted for k in seg.find(name)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([n for n, _ in found], pa.int64()), "ids": pa.array([x for _, x in found], pa.list_(pa.int64()))})

    wanted = sorted(set(doc_ids))
    near = reduce(Column.__or__, [F.lit(x).between(F.col("first_id"), F.col("last_id")) for x in wanted], F.lit(False))
    return spark.read.schema(SEGMENTS).parquet(path).where(near).select("record").mapInArrow(run, "doc_id long, ids array<long>")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    target = scratch_path(spark, "op1")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), target, path("byte_bpe_50k.json"))
    return read_token_files(spark, target)
