"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

1. Each task cuts its documents into pre-tokens, groups them in chunks of bounded size and numbers
   the distinct words of a chunk as they first occur. Words go out with their numbers once a
   chunk, packed into one row for each word bucket (a hash of the word).
2. A bucket meets its words from all chunks; each distinct word is encoded once there, and the
   ids return to the chunks, packed with the numbers.
3. The chunk's documents come as arrays of word numbers, that is by position; the ids of the words
   are put in at their positions. Decoding joins the ids of the chunk's words to the token-byte table, which goes
   to the tasks as a broadcast: it has a row a token, whatever the corpus.

Positions thus travel as one number each and words once a chunk, in a few thousand rows rather
than one row a pre-token. Step 1 runs once for the words and once for the numbers, which moves less than writing
the numbers would; a digest of the word list makes sure that both saw the same. Input that isn't read straight from
files (a shuffle's rows may come in another order after a loss) is written to the shared folder first.

The pattern's classes agree for all characters of Unicode 15.1 between the library and the cutter here. A text with
a character that is newer or in no use is one word, which the encoder splits itself.

Defined cases: null text is empty (no ids, digests of the empty string); documents of equal or
null doc_id stay separate rows; an empty table gives no row.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import plain, slices, stash

#: Between packed words: a byte that UTF-8 never uses.
GAP = "\udcff"
CHUNK_CHARS = 16_000_000
#: Buckets of words at most: with more, a chunk's words would go out in more rows, of a few words each.
BUCKETS = 8192

ROWS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("digest", pa.int64()), ("numbers", pa.binary()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])
ROWS_SQL = "chunk long, bucket int, digest long, numbers binary, payload binary, doc_ids array<long>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encoding(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


@cache
def held_encoding(path: str):
    """One encoder for the life of a Python worker."""
    return encoding(path)


@cache
def strays() -> np.ndarray:
    """Of each code point, whether it has no class in Unicode 15.1, so that a library of another version may class it."""
    table = unicodedata if unicodedata.unidata_version.startswith("15.") else unicodedata.ucd_3_2_0
    return np.array([table.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])


def is_cut_alike(text: str) -> bool:
    """Whether the cutter here has the classes of the library for all of the text's characters."""
    return text.isascii() or not strays()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any()


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """The token-byte table: id, token."""
    return spark.createDataFrame([(rank, bytearray(token)) for token, rank in read_ranks(path).items()], "id long, token binary")


def _broadcast(table: DataFrame):
    """The table's tokens by id, in the tasks. It has a row a token of the vocabulary."""
    rows = {r.id: bytes(r.token) for r in table.collect()}
    tokens = pa.array([rows.get(k, b"") for k in range(max(rows, default=-1) + 1)], pa.binary())
    return table.sparkSession.sparkContext.broadcast(tokens)


def spelt(names: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Runs of ids joined to what stands for an id: the run k ends in front of ends[k]."""
    if not len(ends):
        return []
    found = names.take(pa.array(ids))
    if not len(found):
        return [b""] * len(ends)
    _, offsets, data = found.buffers()
    data, at = data.to_pybytes(), np.frombuffer(offsets, np.int32, len(found) + 1)[ends].tolist()
    return [data[a:b] for a, b in zip([0, *at], at)]


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as compressed byte planes."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class Numbers(dict):
    """Words numbered as they are first asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _chunks(batches: Iterator[pa.RecordBatch], most: int, coded: bool) -> Iterator[tuple[int, list, list[np.ndarray], list[str]]]:
    """(chunk, doc_ids, word numbers of each document if coded, distinct words by number): bounded by characters.

    Words are numbered as they first occur; of a document only the numbers are held.
    """
    from public_tokenizers import PATTERN

    find, part, chunk = regex.compile(PATTERN).findall, TaskContext.get().partitionId(), 0
    names, codes, numbers, size = [], [], Numbers(), 0
    for batch in slices(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = find(text) if is_cut_alike(text) else [text]
            names.append(doc_id)
            if coded:
                codes.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            else:
                numbers.update(dict.fromkeys(words))
            size += len(text) + 100
            if size >= most:
                yield part << 32 | chunk, names, codes, list(numbers)
                names, codes, numbers, size, chunk = [], [], Numbers(), 0, chunk + 1
    if names:
        yield part << 32 | chunk, names, codes, list(numbers)


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: pa.array([values.get(f.name)], f.type) for f in ROWS}, schema=ROWS)


def _joined(words: list[str]) -> bytes:
    return GAP.join(words).encode("utf-8", "surrogateescape")


def _word_rows(buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, _, words in _chunks(batches, most, False):
            digest = zlib.crc32(_joined(words))
            to = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) % buckets
            order = np.argsort(to, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []:
                packed = zstandard.compress(_joined([words[k] for k in group.tolist()]), 1)
                yield _row(chunk=chunk, bucket=int(to[group[0]]), digest=digest, numbers=_pack(np.diff(group, prepend=0)), payload=packed)

    return run


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, last = held_encoding(path).encode_ordinary, {}, None
        for batch in slices(batches, 16):
            for chunk, bucket, digest, numbers, packed in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if bucket != last:
                    known, last = {}, bucket  # a word is in one bucket only
                words = zstandard.decompress(packed).decode("utf-8", "surrogateescape").split(GAP)
                for word in words:
                    if word not in known:
                        known[word] = array("I", encode(word)).tobytes()
                ids = [known[w] for w in words]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                yield _row(chunk=chunk, bucket=bucket, digest=digest, numbers=numbers, payload=_pack(np.concatenate([[len(ids)], sizes, np.frombuffer(b"".join(ids), "<u4")])))

    return run


def _code_rows(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, names, codes, words in _chunks(batches, most, True):
            sizes = np.fromiter(map(len, codes), np.int64, len(codes))
            yield _row(chunk=chunk, digest=zlib.crc32(_joined(words)), numbers=_pack(sizes), payload=_pack(np.concatenate(codes)), doc_ids=names)

    return run


def _reassemble(tokens, digests: bool):
    def run(coded: pa.Table, encoded: pa.Table) -> pa.Table:
        decimal = pa.array([b"%d " % k for k in range(len(tokens.value))], pa.binary())
        parts = [] if not encoded.num_rows else list(zip(*(encoded.column(k).to_pylist() for k in ("digest", "numbers", "payload"))))
        places = [np.cumsum(_unpack(numbers)) for _, numbers, _ in parts]
        size = sum(map(len, places))
        ids_of, text_of, count = [b""] * size, [b""] * size, np.zeros(size, np.int64)
        for (_, _, words), place in zip(parts, places):
            flat = _unpack(words)
            n = int(flat[0])
            ends = np.cumsum(flat[1 : n + 1].astype(np.int64))
            count[place] = flat[1 : n + 1]
            for k, own, text in zip(place.tolist(), spelt(decimal, flat[n + 1 :], ends), spelt(tokens.value, flat[n + 1 :], ends)):
                ids_of[k], text_of[k] = own, text
        out: dict[str, list] = {"doc_id": [], "n_tokens": [], "ids": [], "decoded": []}
        for digest, numbers, payload, names in zip(*(coded.column(k).to_pylist() for k in ("digest", "numbers", "payload", "doc_ids"))):
            codes, ends = _unpack(payload), np.cumsum(_unpack(numbers)).tolist()
            if any(p[0] != digest for p in parts) or codes.size and size <= int(codes.max()):
                raise RuntimeError("the input was not read alike twice")
            for k, name in enumerate(names):
                own = codes[ends[k - 1] if k else 0 : ends[k]]
                at = own.tolist()
                ids, text = b"".join([ids_of[c] for c in at])[:-1], b"".join([text_of[c] for c in at])
                out["doc_id"].append(name)
                out["n_tokens"].append(int(count[own].sum()))
                out["ids"].append(hashlib.sha256(ids).hexdigest() if digests else ids.decode())
                out["decoded"].append(hashlib.sha256(text).hexdigest() if digests else text)
        kinds = pa.int64(), pa.int64(), pa.string(), pa.string() if digests else pa.binary()
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds)})

    return run


def _reads_alike(df: DataFrame) -> bool:
    """Whether the rows come straight from files: no step between may give them in another order."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.child()
    return node.nodeName() == "LogicalRelation" or node.nodeName().startswith("Relation")


def encode_and_decode(docs: DataFrame, ranks: str, *, digests: bool = False, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (decimal, joined by blanks) and the bytes decoded from them; with digests, the SHA-256 of both."""
    spark, source = docs.sparkSession, plain(docs)
    if not _reads_alike(source):
        source = stash(source, "texts")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = source.mapInArrow(_word_rows(min(4 * parts, BUCKETS), chunk_chars), ROWS_SQL)
    encoded = words.repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(_encode_words(ranks), ROWS_SQL)
    coded = source.mapInArrow(_code_rows(chunk_chars), ROWS_SQL)
    kind, tokens = "string" if digests else "binary", _broadcast(token_table(spark, ranks))
    return coded.groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(_reassemble(tokens, digests), f"doc_id long, n_tokens long, ids string, decoded {kind}")


def _decode(tokens):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            ids = batch.column(batch.num_columns - 1)
            sizes = np.array([0 if x is None else len(x) for x in ids.to_pylist()], np.int64)
            found = spelt(tokens.value, ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes))
            found = [x if held else None for x, held in zip(found, ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], names=[*batch.schema.names[:-1], "decoded"])

    return run


def decode(rows: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """Replace an array column of ids by `decoded`, the bytes of the token-byte table that is joined to them. A null array stays null."""
    kept = [c for c in rows.columns if c not in (ids, "decoded")]
    frame = rows.select(*[f"`{c}`" for c in kept], F.col(ids).cast("array<long>"))
    tokens = _broadcast(token_table(rows.sparkSession, ranks))
    return frame.mapInArrow(_decode(tokens), ", ".join([*(f"`{c}` {kind}" for c, kind in rows.dtypes if c in kept), "decoded binary"]))


def op5_word_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    out = encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path("byte_bpe_50k.tiktoken"), digests=True)
    return out.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))
