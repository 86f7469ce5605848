"""Phrase collocations by hierarchical pair naming.

Texts are cut once into chunks of one language: an array of numbers, one a word occurrence (0 between pieces), and the chunk's
distinct words with their counts. Words are counted over all chunks and the frequent ones named by ids. From then on
a phrase of k words is a pair of two phrases of k - 1 words that overlap in all but their ends: a chunk lists its distinct
adjacent pairs of named phrases with counts, the pairs are summed over all chunks, the frequent ones get ids, and a join by
pair brings the ids back to the chunks, where they replace the pairs. A phrase can be frequent only if both of its parts are,
so nothing is lost. The pair that an id names is its parent pointers: counts of all first and last parts come down them one
word a level, and what contains a phrase is looked up the same way: a longer candidate that has it holds one
a word longer that has it and is at least as frequent.

Only distinct words and pairs of a chunk are shuffled by key, never occurrences, so a word that is everywhere is
one row a chunk; pairs go by bucket of their hash, a compressed list for each chunk. Names that are few go out to the chunks. Each level's chunks are a written table; a lost executor repeats a level's tasks at most.
A chunk's numbers are compressed columns, and chunks are written, read and sent to Python by few of them at once, so a task's
memory follows the size of a chunk and not how many chunks the task has.

Defined cases: null lang is `und`; null or empty text has no word; doc_id plays no part, so repeated rows all count;
ties are broken by score, frequency and phrase; an empty table gives no row; other columns may have any name;
texts of any length are cut into slices between words, and chunks end between pieces.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramweave.operators.spread import spread

from ._base import BROADCAST_BYTES, bounded, drop_stash, picked, slices, stash

#: Word occurrences of a chunk (a parameter), chunks' worth of them that a task holds open, and bytes of text that are cut at once.
CHUNK, OPEN, SLICE = 1 << 19, 4, 1 << 22
#: Bytes of chunks that a task writes, reads or sends to Python at once, and one chunk more.
AT_ONCE = 8 << 20
#: Pairs of a chunk that are rows at once.
ROWS = 1 << 16
#: Candidates are phrases of 2 to WORDS words that occur LEAST times; the first TOP of a language are reported.
WORDS, LEAST, TOP = 5, 100, 2000
#: A candidate goes if a longer one that holds it has so many hundredths of its frequency.
PERCENT = 100

#: A to Z in lower case; each separator of pieces as one mark, each of words as a space.
_BREAK = b"."
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10 + b" ")


def _tokens(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """Words and marks of a text, a slice at a time; a mark ends it."""
    folded, at = text.translate(_FOLD) + _BREAK, 0
    while at < len(folded):
        end = at + size
        if end < len(folded):
            ends = [k for k in (folded.find(b" ", end), folded.find(_BREAK, end)) if k >= 0]
            end = min(ends)  # the last byte is a mark
        yield folded[at:end].replace(_BREAK, b" . ").split()
        at = end


def squeezed(values: np.ndarray) -> bytes:
    """Numbers of one type, first bytes first, then second ones, ..., compressed; their count stands before."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + (pa.Codec("zstd").compress(planes, asbytes=True) if planes else b"")


def unsqueezed(blob: pa.Scalar, kind: type) -> np.ndarray:
    blob, width = blob.as_buffer(), np.dtype(kind).itemsize
    size = int.from_bytes(blob[:8], "little")  # of nothing is 0
    if not size:
        return np.zeros(0, kind)
    planes = pa.Codec("zstd").decompress(blob[8:], size * width)
    return np.frombuffer(planes, np.uint8).reshape(width, size).T.copy().view(kind)[:, 0]


class _Open:
    """A chunk that is being filled."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)  # a factory that held the words would keep them past the chunk's end
        self.numbers[_BREAK]  # is 0
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, tokens: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens)))
        self.size += len(tokens)

    def row(self, chunk: int, lang: str) -> pa.RecordBatch:
        places = np.concatenate(self.parts)
        counts = np.bincount(places, minlength=len(self.numbers))[1:]
        words = pa.array(list(self.numbers)[1:], pa.binary()).cast(pa.string())
        lists = [pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), values) for values in (words, pa.array(counts.astype(np.int64)))]
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([lang]), pa.array([squeezed(places)], pa.binary()), *lists], ["chunk", "lang", "places", "words", "counts"])


def _chunked(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_chunks: defaultdict[str, _Open] = defaultdict(_Open)
        next_chunk, size = TaskContext.get().partitionId() << 33, 0
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for tokens in _tokens(text, 16 * chunk):
                    open_chunks[lang].add(tokens)
                    size += len(tokens)
                    if tokens[-1] != _BREAK:  # within a piece
                        continue
                    full = list(open_chunks) if size >= OPEN * chunk else [lang] if open_chunks[lang].size >= chunk else []
                    for name in full:
                        done = open_chunks.pop(name)
                        size -= done.size
                        row = done.row(next_chunk, name)
                        del done
                        yield row
                        next_chunk += 1
        for name, done in open_chunks.items():
            yield done.row(next_chunk, name)
            next_chunk += 1

    return run


def chunks(docs: DataFrame, lang: str = "lang", chunk: int = CHUNK) -> DataFrame:
    """(chunk, lang, places, words, counts): place by place the number of a word in the chunk's list from 1, 0 between pieces; compressed."""
    rows = picked(docs, lang, "text").toDF("lang", "text").where("text IS NOT NULL")
    rows = rows.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_chunked(chunk), "chunk long, lang string, places binary, words array<string>, counts array<long>")


PAIRS_DDL = "chunk long, places binary, numbers binary, lefts binary, rights binary, counts binary"
PAIRS = pa.schema([("chunk", pa.int64()), *[(name, pa.binary()) for name in ("places", "numbers", "lefts", "rights", "counts")]])


def _pairs_of(chunk: int, places: np.ndarray, numbers: np.ndarray, ids: np.ndarray, last: bool) -> pa.RecordBatch | None:
    """A chunk of one level more: the adjacent pairs of its named phrases, which ones they are, and how often each occurs."""
    kept = ids[numbers] > 0
    places, numbers = places[kept], numbers[kept]
    next_to = np.flatnonzero(places[1:] == places[:-1] + 1)
    if not len(next_to):
        return None
    pairs, inverse, counts = np.unique(numbers[next_to].astype(np.int64) << 32 | numbers[next_to + 1], return_inverse=True, return_counts=True)
    blobs = [b"", b""] if last else [squeezed(np.diff(places[next_to], prepend=np.int32(0))), squeezed(inverse.astype(np.int32))]
    blobs += [squeezed(values) for values in (ids[pairs >> 32], ids[pairs & 0xFFFFFFFF], counts.astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *[pa.array([b], pa.binary()) for b in blobs]], PAIRS.names)


def _read(places: pa.Scalar, numbers: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    numbers = unsqueezed(numbers, np.int32)
    steps = unsqueezed(places, np.int32)
    return np.cumsum(steps, dtype=np.int32) if len(steps) else np.arange(len(numbers), dtype=np.int32), numbers


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of chunks as rows."""
    for batch in batches:
        for k in range(batch.num_rows):
            chunk, left, right = batch.column(0)[k].as_py(), *(unsqueezed(batch.column(c)[k], np.int64) for c in (1, 2))
            for at in range(0, len(left), ROWS):
                own = left[at : at + ROWS], right[at : at + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own[0]), chunk)), pa.array(np.arange(at, at + len(own[0]))), *map(pa.array, own)], ["of", "number", "left", "right"])


def _paired_by_group(last: bool):
    """A level where names are many: a chunk comes with the names of its phrases."""

    def run(own: pa.Table, named: pa.Table) -> pa.Table:
        batch = None
        if own.num_rows and named.num_rows:
            places, numbers = _read(own["places"][0], own["numbers"][0])
            ids = np.zeros(int(numbers.max(initial=0)) + 1, np.int64)
            ids[named["number"].to_numpy()] = named["id"].to_numpy()
            batch = _pairs_of(own["chunk"][0].as_py(), places, numbers, ids, last)
        return PAIRS.empty_table() if batch is None else pa.Table.from_batches([batch])

    return run


class _Words:
    """Ids of a chunk's words."""

    columns = ("lang", "words")

    def __init__(self, names: pa.Table) -> None:
        self.names, self.of = names, {}

    def ids(self, lang: pa.Scalar, words: pa.Scalar) -> np.ndarray:
        if lang.as_py() not in self.of:
            own = self.names.filter(pc.equal(self.names["lang"], lang.as_py()))
            self.of[lang.as_py()] = own["phrase"].cast(pa.string()).combine_chunks(), np.append(own["id"].to_numpy(), 0)
        known, ids = self.of[lang.as_py()]
        at = pc.index_in(words.values.cast(pa.string()), value_set=known)
        return np.append(0, ids[pc.fill_null(at, len(known)).to_numpy()])  # 0 is the end of a piece


class _Names:
    """Ids of a chunk's pairs."""

    columns = ("lefts", "rights")

    def __init__(self, names: pa.Table) -> None:
        left, right, ids = (names[c].to_numpy() for c in ("left", "right", "id"))
        self.left, self.right = np.unique(left), np.unique(right)
        keys = np.searchsorted(self.left, left) * len(self.right) + np.searchsorted(self.right, right)
        order = np.argsort(keys)
        self.keys, self.of = keys[order], ids[order]

    def ids(self, lefts: pa.Scalar, rights: pa.Scalar) -> np.ndarray:
        left, right = unsqueezed(lefts, np.int64), unsqueezed(rights, np.int64)
        if not len(self.keys):
            return np.zeros(len(left), np.int64)
        at = []
        for values, known in ((left, self.left), (right, self.right)):
            place = np.minimum(np.searchsorted(known, values), len(known) - 1)
            at.append((place, known[place] == values))
        keys = at[0][0] * len(self.right) + at[1][0]
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(at[0][1] & at[1][1] & (self.keys[place] == keys), self.of[place], 0)


def _paired_in_place(names, kind: type, last: bool):
    """A level where names are few: they go out to the chunks, which stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kind(names.value)
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, places, numbers, *lists = (batch.column(c)[k] for c in range(batch.num_columns))
                found = _pairs_of(chunk.as_py(), *_read(places, numbers), known.ids(*lists), last)
                if found is not None:
                    yield found

    return run


def _packed(buckets: int):
    """A chunk's pairs and counts by hash of the pair: sorted, the first ids as steps, and compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            for k in range(batch.num_rows):
                left, right, counts = (unsqueezed(batch.column(c)[k], np.int64) for c in range(3))
                bucket = (left * np.int64(0x9E3779B97F4A7C1) ^ right * np.int64(0x2545F4914F6CDD1D)).view(np.uint64) >> np.uint64(24)
                bucket = (bucket % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((right, left, bucket))
                left, right, counts, bucket = left[order], right[order], counts[order], bucket[order]
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(starts[1:], len(bucket))
                packs = []
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    packs.append(codec.compress(np.concatenate([np.diff(left[a:b], prepend=0), right[a:b], counts[a:b]]).tobytes(), asbytes=True))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(ends - starts), pa.array(packs, pa.binary())], ["bucket", "size", "pack"])

    return run


def _counted(least: int):
    """The frequent pairs of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        codec = pa.Codec("zstd")
        parts = [np.frombuffer(codec.decompress(pack, 24 * size, asbytes=True), np.int64).reshape(3, size) for size, pack in zip(table["size"].to_pylist(), table["pack"].to_pylist(), strict=True)]
        left = np.concatenate([np.cumsum(p[0]) for p in parts])
        right, counts = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        order = np.lexsort((right, left))
        left, right, counts = left[order], right[order], counts[order]
        starts = np.flatnonzero((np.diff(left, prepend=-1) != 0) | (np.diff(right, prepend=-1) != 0))
        total = np.add.reduceat(counts, starts)
        kept = total >= least
        return pa.table({"left": left[starts[kept]], "right": right[starts[kept]], "f": total[kept]})

    return run


def _with_ids(counted: DataFrame, tag: str) -> DataFrame:
    """A written table of frequent phrases, each with an id above 0."""
    return stash(counted.select((F.monotonically_increasing_id() + 1).alias("id"), "*"), tag)


#: Pairs of a bucket, about.
BUCKET = 1 << 20


def _stashed(chunks: DataFrame, tag: str) -> DataFrame:
    """A written table of chunks, in row groups of AT_ONCE bytes: its sizes are looked at from the first row on, not from the hundredth."""
    return stash(chunks, tag, options={"parquet.block.size": AT_ONCE, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1})


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of AT_ONCE bytes at most, and one row more, inside of the block."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(AT_ONCE))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def phrases(docs: DataFrame, words: int = WORDS, least: int = LEAST, lang: str = "lang", chunk: int = CHUNK, few: int = BROADCAST_BYTES) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of 1 to `words` words, a written table each, and (lang, n).

    A phrase has id, lang, phrase, its last word, the ids `left` and `right` of its parts, and the counts `firsts` and `lasts` of its
    first and last 1, 2, ... words; the last of either is its own. A level's names whose bytes are counted to be at most `few` go out to the
    chunks, others are joined with the chunks' lists and meet the chunks by shuffles; the result is the same.
    """
    with _small_batches(docs.sparkSession):
        return _phrases(docs, words, least, lang, chunk, few)


def _phrases(docs: DataFrame, words: int, least: int, lang: str, chunk: int, few: int) -> tuple[list[DataFrame], DataFrame]:
    spark = docs.sparkSession
    own = _stashed(chunks(docs, lang, chunk), "chunks")
    listed = own.select(F.col("chunk").alias("of"), "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("of", "lang", (F.col("at") + 1).alias("number"), F.col("x.words").alias("word"), F.col("x.counts").alias("count"))
    totals = stash(own.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    counted = listed.groupBy("lang", "word").agg(F.sum("count").alias("f")).where(F.col("f") >= least)
    none = F.lit(None).cast("long")
    levels = [_with_ids(counted.select("lang", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("left"), none.alias("right"), "f", F.array("f").alias("firsts"), F.array("f").alias("lasts")), "words")]
    buckets = max(spark.sparkContext.defaultParallelism, (totals.agg(F.sum("n")).first()[0] or 0) // BUCKET)
    sent = []
    for size in range(2, words + 1):
        names, is_words, last = levels[-1], size == 2, size == words
        blobs = [F.lit(b"").alias("places"), F.col("places").alias("numbers")] if is_words else ["places", "numbers"]
        if names.count() * (64 if is_words else 24) <= few:
            kind = _Words if is_words else _Names
            sent.append(spark.sparkContext.broadcast(names.select(*(("lang", "phrase", "id") if is_words else ("left", "right", "id"))).toArrow()))
            paired = own.select("chunk", *blobs, *kind.columns).mapInArrow(_paired_in_place(sent[-1], kind, last), PAIRS_DDL)
        else:
            if is_words:
                named = listed.join(names.select("id", "lang", F.col("phrase").alias("word")), ["lang", "word"])
            else:
                listed = own.select("chunk", "lefts", "rights").mapInArrow(_rows_of, "of long, number long, left long, right long")
                named = listed.join(names.select("id", "left", "right"), ["left", "right"])
            paired = own.select("chunk", *blobs).groupBy("chunk").cogroup(named.select("of", "number", "id").groupBy("of")).applyInArrow(_paired_by_group(last), PAIRS_DDL)
        earlier, own = own, _stashed(paired, "pairs")
        drop_stash(earlier)
        packed = own.select("lefts", "rights", "counts").mapInArrow(_packed(buckets), "bucket long, size long, pack binary")
        # the number is given: packs are small for what they hold
        counted = packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_counted(least), "left long, right long, f long")
        counted = stash(counted, "counts")
        first, rest = _parts(levels[-1])
        joined = counted.join(first, "left").join(rest, "right")
        columns = [F.concat_ws(" ", "first_phrase", "last").alias("phrase"), "last", "left", "right", "f", F.concat("firsts", F.array("f")).alias("firsts"), F.concat("lasts", F.array("f")).alias("lasts")]
        levels.append(_with_ids(joined.select("lang", *columns), "phrases"))
        drop_stash(counted)
    drop_stash(own)
    for names in sent:
        names.destroy()
    return levels, totals


def _parts(level: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A level as first parts and as last parts of the next one; broadcast where it is counted to be small."""
    small = bounded(level, 160)
    return small.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("first_phrase"), "firsts"), small.select(F.col("id").alias("right"), "last", "lasts")


def _cuts(size: int) -> Column:
    """Of the cuts after 1, 2, ... words the one of the lowest score; the first of equals."""

    def cut(k: int) -> Column:
        l, r = F.get("firsts", F.lit(k - 1)), F.get("lasts", F.lit(size - k - 1))  # noqa: E741
        return F.struct(exact_score(F.col("f"), F.col("n"), l, r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))

    return F.least(*[cut(k) for k in range(1, size)]) if size > 2 else cut(1)


def exact_score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)) in decimals of 38 digits, which hold counts of up to 17 digits."""
    long = lambda c: c.cast("decimal(17,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * long(a) * long(n), long(l) * long(r))


def collocations(docs: DataFrame, words: int = WORDS, least: int = LEAST, percent: int = PERCENT, top: int | None = TOP, lang: str = "lang", chunk: int = CHUNK, few: int = BROADCAST_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, frequency and phrase; all of them if `top` is None."""
    levels, totals = phrases(docs, words, least, lang, chunk, few)
    totals = bounded(totals, 32)
    found = []
    for size, level in enumerate(levels[1:], 2):
        if size < words:
            longer = levels[size].select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("longest")).groupBy("id").agg(F.max("longest").alias("longest"))
            level = level.join(longer, "id", "left").where(F.col("longest").isNull() | (100 * F.col("longest") < percent * F.col("f")))
        found.append(level.join(totals, "lang").select("lang", "phrase", "f", "n", _cuts(size).alias("cut")))
    rows = reduce(DataFrame.unionAll, found).select("lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # a language's candidates are dealt out first, so that no task gets more than a few lists of `top`
        bucket = F.pmod(F.xxhash64("phrase"), F.lit(64))
        rows = rows.select("*", bucket.alias("bucket")).select("*", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order)).alias("rank")).where(F.col("rank") <= top).drop("bucket", "rank")
    ranked = rows.select("lang", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _sql_grams(size: int) -> str:
    return f"SELECT lang, {size} AS size, array_to_string(w[i:i + {size - 1}], ' ') AS phrase, count(*) AS f FROM placed WHERE i + {size - 1} <= len(w) GROUP BY lang, phrase"


def _sql_cuts(size: int) -> str:
    cuts = [f"SELECT c.lang, c.phrase, c.f, {k} AS k, array_to_string(c.w[:{k}], ' ') AS first_part, array_to_string(c.w[{k + 1}:], ' ') AS rest FROM cands c WHERE c.size = {size}" for k in range(1, size)]
    return " UNION ALL ".join(cuts)


ORACLE = rf"""
WITH folded AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM folded),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded WHERE len(w) > 0),
grams AS (SELECT * FROM ({" UNION ALL ".join(_sql_grams(k) for k in range(1, WORDS + 1))}) WHERE f >= {LEAST}),
totals AS (SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang),
cands AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE size >= 2),
cuts AS ({" UNION ALL ".join(_sql_cuts(k) for k in range(2, WORDS + 1))}),
scored AS (SELECT c.lang, c.phrase, c.f AS a, c.k, g.f AS l, h.f AS r, n, (1000::HUGEINT * c.f * n) // (g.f::HUGEINT * h.f) AS score
  FROM cuts c JOIN grams g ON g.lang = c.lang AND g.phrase = c.first_part JOIN grams h ON h.lang = c.lang AND h.phrase = c.rest JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM scored),
held AS (SELECT c.lang, array_to_string(c.w[i:j], ' ') AS phrase, max(c.f) AS longest FROM (SELECT *, unnest(range(1, size + 1)) AS i FROM cands) c, range(1, {WORDS + 1}) AS e(j)
  WHERE j > i AND j <= c.size AND j - i + 1 < c.size GROUP BY 1, 2),
kept AS (SELECT s.* FROM lowest s LEFT JOIN held h ON h.lang = s.lang AND h.phrase = s.phrase WHERE cut = 1 AND (longest IS NULL OR 100 * longest < {PERCENT} * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {TOP}
"""
