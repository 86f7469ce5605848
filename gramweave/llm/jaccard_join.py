"""Similarity self-join on word shingles: T-occurrence search with DivideSkip.

Two texts link when their sets of distinct five-word shingles have a Jaccard likeness of at least
`percent` / 100. A set of n shingles can link only with sets that share T = ceil(n * percent / 100)
of them at least. Of its n inverted lists the T - 1 longest can be left out of the merge: a partner
is in one of the n - T + 1 short ones. DivideSkip merges the short lists and probes the long ones.

1. Each task reads its texts, reduces each to its set, and keeps the set once for equal sets (its
   class). Sets go to a table; nothing with a text is shuffled.
2. Entries of the inverted lists go to buckets of the shingle, packed; of a shingle that many classes of
   a chunk have, only the number goes. A bucket sends back those
   whose shingle has another class, with the list's length; a class whose lists are too few for T
   drops out. The rest order their lists by length, and the entries of the short ones meet by
   shingle: classes of one shingle and of sizes that can link get edges to the least of them (linear
   in the list). Those of one size meet in their chunk already and send one of them on, so a bucket
   gets a common shingle once a chunk and size.
3. Connected classes are a block: all links lie within blocks. Small blocks are searched many to a
   task. A block beyond the bounds of a task is dealt in chunks and each pair of chunks is searched;
   first all of it meets a few hubs, and classes that those join need no search among themselves.
4. A search returns a spanning forest of the links. Components of all of them, and of
   equal sets, get their smallest doc_id.

A search merges up to 256 entries of short lists by a heap, more by sorting. Then it probes: long lists for the partners
(DivideSkip), or, of 24 partners at most, their sets for the long lists' shingles; the counts are the same.
Shingles are 64-bit hashes, of which 46 bits are kept for comparing sets. Sets are told apart by 128 bits; classes
are numbered by 64 of them, and by other ones where two sets agree in those. Defined cases: A-Z count as
a-z; fewer than five words are one shingle; null or empty text and text of blanks only has no
shingle, links with nothing and is its own component; rows of equal doc_id are one node only if
their sets are equal; a null doc_id never names a component unless all its members are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import merge

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramweave.operators.spread import spread

from ._base import drop_stash, plain, slices, stash
from ._graph import components

WIDTH = 5
BITS = np.uint64((1 << 46) - 1)
#: Bounds of what one search task holds: classes and shingles. Blocks of more than FEW classes are dealt in up to PARTS before.
CLASSES, SHINGLES, FEW, PARTS = 4096, 2_000_000, 256, 16
#: Shingles of the classes of one chunk.
CHUNK = 3_000_000
#: Classes of a chunk from which on a shingle's entries stay in it, and their number goes to the bucket.
COMMON = 32
HUBS = 24
BROADCAST_BYTES = 32 << 20


def least_overlap(n: int, m: int, percent: int) -> int:
    """What sets of n and m shingles must share to link."""
    return -(-percent * (n + m) // (100 + percent))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\x20".join(words), seed=len(words))], np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    mixed = own[:n].copy()
    for k in range(1, width):
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += own[k : k + n]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed.sort()
    return mixed[np.append(True, mixed[1:] != mixed[:-1])]


def _pack(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(data) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return wide.view("<u8").ravel()


SETS = "doc_id long, n int, id long, proof long, grams binary"


def _digest(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, 512):
            sizes, ids, proofs, grams = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, width)
                digest = _digest(found)
                ids.append(int.from_bytes(digest[:8], "little", signed=True))
                proofs.append(int.from_bytes(digest[8:], "little", signed=True))
                sizes.append(len(found))
                fresh = len(found) and digest not in seen
                grams.append(_pack(np.unique(found & BITS), 6) if fresh else None)
                if fresh and len(seen) < 1 << 20:
                    seen.add(digest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(ids, pa.int64()), pa.array(proofs, pa.int64()), pa.array(grams, pa.binary())], names=[x.split()[0] for x in SETS.split(", ")])

    return run


def _planes(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


ENTRIES = "chunk long, bucket int, counts binary, grams binary, more binary, common binary"
POSTS = "bucket int, grams binary, ids binary, sizes binary"


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows), fields)], names=[name for name, _ in fields])


def _groups(keys: np.ndarray) -> list[np.ndarray]:
    """Places of each key in turn, keys ascending, places in order."""
    order = np.argsort(keys, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(keys[order])) + 1) if len(keys) else []


def _entries(buckets: int):
    """All entries of the inverted lists, packed for each chunk of classes and bucket of shingles.

    An entry is the shingle's place in its bucket, and its class by how many each class of the chunk
    has there. The chunk's own row (sizes and ids of its classes, and who has its common shingles) goes along in some bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        grams, ids, sizes, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal grams, ids, sizes, held, number
            chunk, classes = part << 32 | number, len(ids)
            flat, owner = np.concatenate(grams), np.repeat(np.arange(classes), [len(g) for g in grams])
            each, inverse, many = np.unique(flat, return_inverse=True, return_counts=True)
            common = many >= COMMON
            stays = common[inverse]
            hot, counts = each[common], many[common]
            owners = owner[stays][np.argsort(flat[stays], kind="stable")]
            yield _rows(ENTRIES, [(chunk, chunk % buckets, _planes(np.array(sizes)), None, np.array(ids, np.int64).tobytes(), _pack(hot, 6) + _planes(np.concatenate([counts, owners])))])
            for group in _groups((hot % np.uint64(buckets)).astype(np.int64)):
                yield _rows(ENTRIES, [(chunk, int(hot[group[0]] % np.uint64(buckets)), _planes(counts[group]), _pack(hot[group] // np.uint64(buckets), 5), None, b"")])
            flat, owner = flat[~stays], owner[~stays]
            to = (flat % np.uint64(buckets)).astype(np.int64)
            for group in _groups(to):
                yield _rows(ENTRIES, [(chunk, int(to[group[0]]), _planes(np.bincount(owner[group], minlength=classes)), _pack(flat[group] // np.uint64(buckets), 5), None, None)])
            grams, ids, sizes, held, number = [], [], [], 0, number + 1

        for batch in slices(batches, 512):
            for own, n, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                grams.append(_unpack(data, 6))
                ids.append(own)
                sizes.append(n)
                held += len(grams[-1])
                if held > CHUNK:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket, the entries whose shingle has another one, with how many it has."""
    held: list[tuple] = []
    last = None

    def flush() -> Iterator[pa.RecordBatch]:
        flat = np.concatenate([grams for _, _, _, grams, _ in held])
        weight = np.concatenate([np.ones(len(grams)) if common is None else counts for _, _, counts, grams, common in held])
        _, inverse = np.unique(flat, return_inverse=True)
        length, at = np.bincount(inverse, weight).astype(np.int64)[inverse], 0
        for chunk, bucket, counts, grams, common in held:
            own = length[at : at + len(grams)]
            at += len(grams)
            stays = own > 1
            if common is not None:
                yield _rows(ENTRIES, [(chunk, bucket, None, _pack(grams, 5), _planes(own), common)])
            elif stays.any():
                owner = np.repeat(np.arange(len(counts)), counts)
                yield _rows(ENTRIES, [(chunk, bucket, _planes(np.bincount(owner[stays], minlength=len(counts))), _pack(grams[stays], 5), _planes(own[stays]), None)])
        held.clear()

    for batch in slices(batches, 16):
        for chunk, bucket, counts, grams, more, common in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if bucket != last and held:
                yield from flush()
            last = bucket
            if grams is None:
                yield _rows(ENTRIES, [(chunk, -1, counts, None, more, common)])
            else:
                held.append((chunk, bucket, _unplanes(counts), _unpack(grams, 5), common))
    if held:
        yield from flush()


def _short(percent: int, buckets: int):
    """The short lists' entries of a chunk's classes: rarest first, those of no other class being the shortest.

    Classes of one shingle and size are connected here (rows of buckets below 0 hold such edges); the least of them goes on.
    """

    def run(rows: pa.Table) -> pa.Table:
        ids, sizes, keys, owners, lengths, own, common, far = None, None, [], [], [], b"", [], []
        for chunk, bucket, counts, grams, more, kind in zip(*(rows.column(c).to_pylist() for c in ("chunk", "bucket", "counts", "grams", "more", "common"))):
            if grams is None:
                sizes, ids, own = _unplanes(counts).astype(np.int64), np.frombuffer(more, np.int64), kind
                continue
            key, length = _unpack(grams, 5) * np.uint64(buckets) + np.uint64(bucket), _unplanes(more)
            if kind is not None:
                common.append(key)
                far.append(length)
            else:
                counts = _unplanes(counts)
                keys.append(key)
                owners.append(np.repeat(np.arange(len(counts)), counts))
                lengths.append(length)
        if common:  # all of the chunk's common shingles came back: in order they are its own
            key, length = np.concatenate(common), np.concatenate(far)
            order = np.argsort(key)
            numbers = _unplanes(own[6 * len(key) :]).astype(np.int64)
            counts = numbers[: len(key)]
            keys.append(np.repeat(key[order], counts))
            lengths.append(np.repeat(length[order], counts))
            owners.append(numbers[len(key) :])
        out = []
        if keys:
            key, owner, length = np.concatenate(keys), np.concatenate(owners), np.concatenate(lengths)
            order = np.lexsort((key, length, owner))
            key, owner = key[order], owner[order]
            count = np.bincount(owner, minlength=len(ids))
            # short lists less those that hold the class alone
            take = (sizes - -(-percent * sizes // 100) + 1) - (sizes - count)
            nth = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
            kept = nth < take[owner]
            key, name, n = key[kept], ids[owner[kept]], sizes[owner[kept]]
            order = np.lexsort((name, n, key))
            key, name, n = key[order], name[order], n[order]
            first = np.append(True, (key[1:] != key[:-1]) | (n[1:] != n[:-1])) if len(key) else np.zeros(0, bool)
            if not first.all():
                hub = name[first][np.cumsum(first) - 1]
                pairs = _pairs(hub[~first], name[~first])
                out.append((-1 - int(rows.column("chunk")[0].as_py() % buckets), pairs[0].tobytes(), pairs[1].tobytes(), None))
            key, name, n = key[first], name[first], n[first]
            to = (key % np.uint64(buckets)).astype(np.int64)
            out += [(int(to[g[0]]), _pack(key[g], 6), name[g].tobytes(), _planes(n[g])) for g in _groups(to)]
        return pa.Table.from_batches([_rows(POSTS, out)] if out else [], schema=pa.schema([("bucket", pa.int32()), ("grams", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary())]))

    return run


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of different numbers."""
    apart = a != b
    order = np.lexsort((b[apart], a[apart]))
    a, b = a[apart][order], b[apart][order]
    fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    return a[fresh], b[fresh]


def _joined(percent: int):
    """Edges that connect the classes of one shingle whose sizes can link."""

    def edges(grams: list[np.ndarray], ids: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        gram, own, n = np.concatenate(grams), np.concatenate(ids), np.concatenate(sizes).astype(np.int64)
        order = np.argsort(gram, kind="stable")
        gram = gram[order]
        twice = np.zeros(len(gram), bool)
        same = gram[1:] == gram[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        order, gram = order[twice], gram[twice]
        own, n = own[order], n[order]
        order = np.lexsort((own, n, gram))
        gram, own, n = gram[order], own[order], n[order]
        start = np.ones(len(gram), bool)
        start[1:] = (gram[1:] != gram[:-1]) | (100 * n[:-1] < percent * n[1:])
        run = np.cumsum(start) - 1
        hub = np.minimum.reduceat(own, np.flatnonzero(start))[run] if len(own) else own
        return found(*_pairs(hub, own))

    def found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        last = None
        for batch in slices(batches, 16):
            for bucket, grams, ids, sizes in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if bucket != last and held[0]:
                    yield edges(*held)
                    held = ([], [], [])
                last = bucket
                if bucket < 0:
                    yield found(np.frombuffer(grams, np.int64), np.frombuffer(ids, np.int64))
                    continue
                for part, value in zip(held, (_unpack(grams, 6), np.frombuffer(ids, np.int64), _unplanes(sizes))):
                    part.append(value)
        if held[0]:
            yield edges(*held)

    return run


class Forest:
    """Union-find over 0..n-1 that keeps the edges which joined something."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = int(up[x])
        return x

    def roots(self) -> np.ndarray:
        while True:
            above = self.up[self.up]
            if (above == self.up).all():
                return above
            self.up = above

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((x, y))


def _merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all short lists with how often each occurs: a heap merge, by sorting if they are long."""
    if sum(map(len, lists)) > 256:
        return np.unique(np.concatenate(lists), return_counts=True)
    found, counts = [], []
    for x in merge(*(part.tolist() for part in lists)):
        if found and found[-1] == x:
            counts[-1] += 1
        else:
            found.append(x)
            counts.append(1)
    return np.array(found, np.int64), np.array(counts, np.int64)


def divide_skip(sets: list[np.ndarray], sizes: np.ndarray, percent: int, groups: np.ndarray | None = None, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (sorted arrays), in ascending order of size.

    With groups, only sets of different groups are compared; with labels, sets of equal label
    count as joined already.
    """
    n = len(sets)
    forest = Forest(n)
    if labels is not None:
        _, first, back = np.unique(labels, return_index=True, return_inverse=True)
        forest.up = np.minimum(np.arange(n), first[back])
    sized = np.argsort(sizes, kind="stable")
    place = np.empty(n, np.int64)
    place[sized] = np.arange(n)
    flat = np.concatenate([sets[k] for k in sized])
    owner = np.repeat(np.arange(n), [len(sets[k]) for k in sized])
    order = np.argsort(flat, kind="stable")  # owners ascend within a list
    _, start, inverse, length = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
    posts = owner[order]
    first = np.concatenate([[0], np.cumsum(length)])
    ends = np.concatenate([[0], np.cumsum([len(sets[k]) for k in sized])])
    ordered = sizes[sized].astype(np.int64)
    for x in range(1, n):
        lists = inverse[ends[x] : ends[x + 1]]
        lists = lists[length[lists] > 1]
        size = int(ordered[x])
        least = -(-percent * size // 100)
        if len(lists) < least:
            continue
        low = int(np.searchsorted(100 * ordered[:x], percent * size))  # partners before it are too small
        lists = lists[np.argsort(length[lists], kind="stable")]
        # shingles in no other set are the shortest lists, and merged for nothing
        short = len(lists) - least + 1
        near, count = _merged([posts[first[m] : first[m + 1]] for m in lists[:short]])
        own = (near >= low) & (near < x)
        if groups is not None:
            own &= groups[sized[near]] != groups[sized[x]]
        near, count = near[own], count[own]
        if not len(near):
            continue
        apart = forest.roots()[sized[near]] != forest.root(int(sized[x]))
        near, count = near[apart], count[apart]
        if not len(near):
            continue
        need = -(-percent * (size + ordered[near]) // (100 + percent))
        long = lists[short:]
        if len(near) <= 24:  # probe the partners' sets for the long lists' shingles
            asked = flat[order[first[long]]]
            for y, have, want in zip(near.tolist(), count.tolist(), need.tolist()):
                if forest.root(int(sized[x])) == forest.root(int(sized[y])):
                    continue
                other = sets[sized[y]]
                at = np.searchsorted(other, asked)
                if have + int((other[np.minimum(at, len(other) - 1)] == asked).sum()) >= want:
                    forest.join(int(sized[x]), int(sized[y]))
            continue
        for k, m in enumerate(long):  # probe each long list for the partners that can still reach T
            post = posts[first[m] : first[m + 1]]
            at = np.searchsorted(post, near)
            count = count + (post[np.minimum(at, len(post) - 1)] == near)
            if k % 8 == 7:
                alive = count + (len(long) - k - 1) >= need
                near, count, need = near[alive], count[alive], need[alive]
                if not len(near):
                    break
        for y in near[count >= need].tolist():
            forest.join(int(sized[x]), int(sized[y]))
    return forest.edges


def _search(percent: int, chunks: bool):
    """Links of one task's classes: of whole blocks, or of a pair of chunks of one block."""

    def run(rows: pa.Table) -> pa.Table:
        ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
        _, fresh = np.unique(ids, return_index=True)
        data, out = rows.column("grams"), []
        block, chunk, label = (rows.column(c).to_numpy() for c in ("block", "chunk", "label"))
        for one in np.unique(block[fresh]):
            own = fresh[block[fresh] == one]
            sets = [_unpack(data[int(k)].as_py(), 6) for k in own]
            cut = chunk[own] if chunks and len(np.unique(chunk[own])) > 1 else None
            out += [(int(ids[own[a]]), int(ids[own[b]])) for a, b in divide_skip(sets, n[own], percent, cut, label[own])]
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _small(df: DataFrame, width: int) -> bool:
    """Whether a table may be broadcast: its rows are counted."""
    return df.count() * width <= BROADCAST_BYTES


def _with_sets(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The classes with their sets: only classes of some block come here."""
    return sets.join(F.broadcast(classes) if _small(classes, 64) else classes, "id")


def link_classes(sets: DataFrame, percent: int) -> DataFrame:
    """(id, root) of classes that are linked, directly or over others. `sets` has id, n, grams."""
    spark = sets.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # at least 256 buckets: a shingle's place in one takes five bytes
    buckets = max(256, 4 * parts)
    entries = sets.select("id", "n", "grams").mapInArrow(_entries(buckets), ENTRIES)
    shared = entries.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, ENTRIES)
    posts = shared.groupBy("chunk").applyInArrow(_short(percent, buckets), POSTS)
    edges = posts.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_joined(percent), "a long, b long")
    blocks = components(edges).select("id", F.col("root").alias("block"))
    classes = stash(_with_sets(blocks, sets).groupBy("id", "block").agg(F.first("n").alias("n")), "classes")
    sizes = stash(classes.groupBy("block").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")), "blocks")
    cut = F.ceil(F.greatest(F.least(F.col("m") / FEW, F.lit(PARTS)), F.col("m") / CLASSES, F.col("total") / SHINGLES)).cast("int")
    total = sizes.agg(F.sum("total").alias("n"), F.max(cut).alias("most")).first()
    if total.n is None:
        return blocks.select("id", F.col("block").alias("root"))
    bins = max(parts, -(-total.n // (SHINGLES // 2)))
    large = sizes.where(cut > 1).select("block", "m", cut.alias("cut"))
    small = classes.join(F.broadcast(large) if _small(large, 16) else large, "block", "left_anti")
    task = small.select("id", "block", F.pmod(F.xxhash64("block"), F.lit(bins)).alias("task"), F.lit(0).alias("chunk"), F.col("id").alias("label"))
    links = stash(_with_sets(task, sets).groupBy("task").applyInArrow(_search(percent, False), "a long, b long"), "links")
    if total.most > 1:
        links = stash(links.unionByName(_large(classes, large, sets, percent)), "links")
    return components(links)


def _large(classes: DataFrame, large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of blocks that no task may hold: hubs first, then pairs of chunks that aren't one component yet."""
    own = classes.join(F.broadcast(large) if _small(large, 16) else large, "block")
    own = stash(own.select("id", "block", "m", "cut", F.pmod(F.xxhash64("id"), F.col("cut")).cast("int").alias("chunk")), "large")
    # hubs: about HUBS classes of the first chunk by hash, with every chunk
    hub = F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("m") / F.col("cut"))) < HUBS
    hubs = own.where(hub & (F.col("chunk") == 0)).select("id", "block", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("part"))
    first = own.select("id", "block", F.col("chunk").alias("part"), F.lit(1).alias("chunk")).unionByName(hubs.select("id", "block", "part", F.lit(0).alias("chunk")))
    first = first.groupBy("id", "block", "part").agg(F.min("chunk").alias("chunk"))
    first = first.select("id", "block", "chunk", F.xxhash64("block", "part").alias("task"), F.col("id").alias("label"))
    found = stash(_with_sets(first, sets).groupBy("task", "block").applyInArrow(_search(percent, True), "a long, b long"), "hubs")
    label = components(found).select("id", F.col("root").alias("label"))
    own = stash(own.join(label, "id", "left").select("id", "block", "cut", "chunk", F.coalesce("label", "id").alias("label")), "large")
    # a pair of chunks needs a search unless all its classes bear one label
    held = own.groupBy("block", "cut", "chunk").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    a, b = held.select("block", F.col("chunk").alias("i"), F.col("low").alias("li"), F.col("high").alias("hi")), held.select("block", F.col("chunk").alias("j"), F.col("low").alias("lj"), F.col("high").alias("hj"))
    pairs = stash(a.join(b, "block").where("i <= j and not (li = hi and lj = hj and li = lj)").select("block", "i", "j"), "pairs")
    sides = pairs.select("block", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk"))
    task = own.join(sides, ["block", "chunk"]).select("id", "block", "chunk", F.xxhash64("block", "i", "j").alias("task"), "label")
    more = _with_sets(task, sets).groupBy("task", "block").applyInArrow(_search(percent, True), "a long, b long")
    return found.unionByName(more)


def _told_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows and (id, least, m) of their classes, once no two different sets have one id."""
    turn = 0
    while True:
        groups = rows.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m"), F.min("proof").alias("p"), F.max("proof").alias("q"))
        alike = stash(groups.where("p <> q").select(F.col("id").alias("of")), "alike")
        if not (n := alike.count()):
            drop_stash(alike)
            return rows, groups.select("id", "least", "m")
        turn += 1
        told = rows.join(F.broadcast(alike) if n * 16 <= BROADCAST_BYTES else alike, F.col("id") == F.col("of"), "left")
        older, rows = rows, stash(told.withColumn("id", F.when(F.col("of").isNotNull(), F.xxhash64("id", "proof", F.lit(turn))).otherwise(F.col("id"))).drop("of"), "sets", "uncompressed")
        drop_stash(older, alike)


#: Classes of more copies than this, or than a millionth of all rows, are named by a broadcast: there are a million at most.
COPIES, MOST_COPIED = 10_000, 1_000_000


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows, groups = _told_apart(stash(plain(docs).mapInArrow(_sets(width), SETS), "sets", "uncompressed"))
    sets = rows.where("grams is not null").select("id", "n", "grams")
    linked = link_classes(sets, percent)
    rooted = groups.join(linked, "id", "left").select("id", "least", "m", "root")
    named = rooted.where("root is not null").groupBy("root").agg(F.min("least").alias("component"))
    # only classes with copies or links need a name other than their own row's
    names = rooted.where("m > 1 or root is not null").join(named, "root", "left").select("id", "m", F.coalesce("component", "least").alias("component"))
    names = stash(names, "names")
    # the many copies of one text get their name where they are; the others by a join
    many = F.col("m") > max(COPIES, rows.count() // MOST_COPIED)
    copied, others = names.where(many).select(F.col("id").alias("copied"), F.col("component").alias("name")), names.where(~many).select(F.col("id").alias("other"), "component")
    found = rows.select("doc_id", "n", "id").join(F.broadcast(copied), (F.col("id") == F.col("copied")) & (F.col("n") > 0), "left")
    found = found.withColumn("key", F.when(F.col("copied").isNull() & (F.col("n") > 0), F.col("id")).otherwise(F.monotonically_increasing_id()))
    found = found.join(others, (F.col("key") == F.col("other")) & F.col("copied").isNull() & (F.col("n") > 0), "left")
    found = found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("name", "component", "doc_id").alias("component_id"))
    found = stash(found, "components")
    drop_stash(rows, names)
    return found


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT row_no, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM words),
sizes AS (SELECT row_no, count(*) AS n FROM grams GROUP BY row_no),
shared AS (SELECT a.row_no AS a, b.row_no AS b, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.row_no < b.row_no GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.row_no JOIN sizes y ON b = y.row_no WHERE 100 * i >= 80 * (x.n + y.n - i)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a, a AS b FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
named AS (SELECT reach.a AS row_no, min(doc_id) AS component_id FROM reach JOIN words ON reach.b = words.row_no GROUP BY reach.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM words LEFT JOIN sizes USING (row_no) LEFT JOIN named USING (row_no)
"""
