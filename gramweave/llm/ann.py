"""Approximate nearest neighbours: inverted lists of product-quantised residuals, exact reranking.

Fit (driver, on a sample of at most `sample` rows, the smallest by a hash of vec_id): coarse
centroids, one codebook of residuals for each subspace, and, by brute force inside the sample, how
many lists to probe and how many candidates to rerank for the wanted coverage. Where the square root of the rows
exceeds what the sample can place, lists are coarse centroids joined with shared centroids of the residuals: their number
follows the rows then too. Index: every row
gets its list and code. Lists fill shards of about `shard_rows` rows; a longer list (many equal
vectors) is dealt over several shards, so no task holds more. Search: a query goes once to each
shard that holds a list it probes; there its asymmetric distance table of each list ranks the
codes, the best are measured exactly, and the shards' best lists are merged. A shard is copied only if more than
`query_rows` queries come to it, once for as many.

Equal vectors share a code, so a shard keeps only the k + 1 smallest ids of each: no other can be
in an answer. Vectors of different lengths have no distance, so each length is a table of its own. Defined cases:
vectors that are null, empty, zero
or hold null or non-finite numbers take no part; ties go to the smaller vec_id; rows of equal vec_id
are separate candidates, but not of a query of that id; rows without vec_id take no part; with
fewer rows than k all candidates return; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._base import bounded, stash, told_apart


@dataclass(frozen=True)
class Model:
    base: np.ndarray  # centroids x dimensions
    finer: np.ndarray  # shared centroids of the residuals, one of zeros if lists are the centroids
    books: np.ndarray  # subspaces x codes x width, zero-padded dimensions
    probe: int
    rerank: int

    @property
    def count(self) -> int:
        """The number of lists; their middles are never all formed, in the driver or in a task."""
        return len(self.base) * len(self.finer)

    def middles(self, lists: np.ndarray) -> np.ndarray:
        return self.base[lists // len(self.finer)] + self.finer[lists % len(self.finer)]

    def far(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of some rows to the middles of all lists, from those to both kinds of centroids."""
        across = (x @ self.finer.T)[:, None] - self.base @ self.finer.T
        return (squares(x, self.base)[:, :, None] - 2 * across + (self.finer**2).sum(1)).reshape(len(x), -1)

    @property
    def width(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.width - x.shape[1])))

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid, then the nearest one of what is left."""
        near = nearest(x, self.base)
        return near * len(self.finer) + nearest(x - self.base[near], self.finer)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = self.padded(x - self.middles(lists))
        step = self.books.shape[2]
        return np.stack([nearest(rest[:, s * step : (s + 1) * step], book) for s, book in enumerate(self.books)], 1).astype(np.uint8)

    def decoded(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        rest = np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], 1)
        return self.middles(lists) + rest[:, : self.base.shape[1]]

    def tables(self, query: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Squared distances of the query's residuals to the codes: lists x subspaces x codes."""
        rest = self.padded(query - self.middles(lists)).reshape(len(lists), self.books.shape[0], 1, self.books.shape[2])
        return ((rest - self.books) ** 2).sum(3)

    def probed(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The nearest lists of each query, a few queries at a time."""
        step = max(1, (1 << 22) // self.count)
        for at in range(0, len(x), step):
            far = self.far(x[at : at + step])
            if self.probe >= far.shape[1]:
                yield from np.broadcast_to(np.arange(far.shape[1]), far.shape)
            else:
                yield from np.argpartition(far, self.probe - 1, axis=1)[:, : self.probe]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, a few rows at a time."""
    step = max(1, (1 << 22) // len(centres))
    return np.concatenate([squares(x[a : a + step], centres).argmin(1) for a in range(0, max(len(x), 1), step)])


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        order = np.argsort(near, kind="stable")
        used, first = np.unique(near[order], return_index=True)
        centres[used] = np.add.reduceat(x[order], first) / np.diff(np.append(first, len(x)))[:, None]
        empty = np.setdiff1d(np.arange(len(centres)), used)
        centres[empty] = x[rng.integers(0, len(x), len(empty))]
    return centres


#: Shared centroids of the residuals at most, where lists are pairs of both.
FINER = 64


def fit(x: np.ndarray, rows: int, *, k: int, subspaces: int = 16, cover: float = 0.985, seed: int = 7) -> Model:
    """A model from a sample x of a table of so many rows."""
    lists = int(np.clip(round(rows**0.5), 1, max(1, len(x) // 8)))
    base = kmeans(x, lists, 8, seed)
    finer = np.zeros((1, x.shape[1]))
    if (more := min(FINER, round(rows**0.5 / lists))) > 1:
        finer = kmeans(x - base[nearest(x, base)], more, 8, seed)
    subspaces = min(subspaces, x.shape[1])
    width = -(-x.shape[1] // subspaces)
    model = Model(base, finer, np.zeros((subspaces, 1, width)), len(base) * len(finer), len(x))
    rest = model.padded(x - model.middles(own := model.lists(x)))
    books = np.zeros((subspaces, min(256, len(x)), width))
    for s in range(subspaces):
        books[s] = kmeans(rest[:, s * width : (s + 1) * width], books.shape[1], 6, seed + s)
    model = replace(model, books=books)
    spelt = model.decoded(own, model.codes(x, own))
    asked = np.random.default_rng(seed).choice(len(x), min(160, len(x)), replace=False)
    depth, ranks = [], []
    for q in asked:
        exact = ((x - x[q]) ** 2).sum(1)
        exact[q] = np.inf
        true = np.argsort(exact, kind="stable")[: min(k, len(x) - 1)]
        far = model.far(x[q : q + 1])[0]
        depth += [int((far < far[m]).sum()) for m in own[true]]
        near = ((spelt - x[q]) ** 2).sum(1)  # what the query's tables add up to
        ranks += [int((near < v).sum()) for v in near[true]]
    reach = lambda v: int(np.quantile(v, cover)) + 1 if v else 1
    return replace(model, probe=min(model.count, reach(depth)), rerank=2 * reach(ranks) + 4 * k)


def _usable(vector: str) -> Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _assign(model: Model, size: int):
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), size)
            lists = model.lists(x) if len(x) else np.zeros(0, np.int64)
            codes = model.codes(x, lists) if len(x) else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "vector", "list", "code"])

    return run


def _route(model: Model, size: int, first: np.ndarray, parts: np.ndarray):
    """Each query once to every shard that holds a list it probes."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            to = [np.unique(np.concatenate([first[m] + np.arange(parts[m]) for m in own])) for own in model.probed(_matrix(batch.column(1), size))]
            row = np.repeat(np.arange(len(to)), [len(t) for t in to])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(np.concatenate(to).astype(np.int32))], names=["query_id", "vector", "shard"])

    return run


def _least(values: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n least values, ties to smaller ids, in order."""
    if len(values) > n:
        edge = np.partition(values, n - 1)[n - 1]
        few = np.flatnonzero(values <= edge)
    else:
        few = np.arange(len(values))
    return few[np.lexsort((ids[few], values[few]))[:n]]


def _search(model: Model, size: int, k: int):
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return empty
        ids, x = rows.column("vec_id").to_numpy(), _matrix(rows.column("vector"), size)
        lists, codes = rows.column("list").to_numpy(), np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        order = np.lexsort((ids, *x.T[::-1]))  # equal vectors together, by id
        fresh = np.append(True, (np.diff(x[order], axis=0) != 0).any(1))
        nth = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        order = order[nth <= k]
        order = order[np.argsort(lists[order], kind="stable")]
        ids, x, lists, codes = ids[order], x[order], lists[order], codes[order].astype(np.int64)
        held, first = np.unique(lists, return_index=True)
        last = np.append(first[1:], len(lists))
        flat = codes + np.arange(codes.shape[1]) * model.books.shape[1]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        names, asked = queries.column("query_id").to_numpy(), _matrix(queries.column("vector"), size)
        for name, query, probed in zip(names, asked, model.probed(asked)):
            own = np.flatnonzero(np.isin(held, probed))
            if not len(own):
                continue
            tables = model.tables(query, held[own]).reshape(len(own), -1)
            near = np.concatenate([table[flat[first[m] : last[m]]].sum(1) for table, m in zip(tables, own)])
            at = np.concatenate([np.arange(first[m], last[m]) for m in own])
            few = at[_least(near, ids[at], model.rerank + 1)]
            few = few[ids[few] != name]
            exact = np.sqrt(((x[few] - query) ** 2).sum(1))
            best = _least(exact, ids[few], k)
            out.append((np.full(len(best), name), ids[few][best], exact[best]))
        if not out:
            return empty
        return pa.table({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), zip(*out))})

    return run


def _deal(first: np.ndarray, parts: np.ndarray):
    """Rows of the index with their shard: long lists are dealt by vec_id."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2).to_numpy()
            nth = batch.column(4).to_numpy().astype(np.uint64) % parts[lists].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array((first[lists] + nth.astype(np.int64)).astype(np.int32))], names=["vec_id", "vector", "list", "code", "shard"])

    return run


def shards(counts: np.ndarray, shard_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shard of each list, and over how many it is dealt: neighbours of few rows share one."""
    parts = np.maximum(1, -(-counts // shard_rows))
    first, shard, room = np.zeros(len(counts), np.int64), -1, 0
    for m in range(len(counts)):
        if parts[m] > 1 or counts[m] > room:
            first[m], shard, room = shard + 1, shard + int(parts[m]), 0 if parts[m] > 1 else shard_rows - int(counts[m])
        else:
            first[m], room = shard, room - int(counts[m])
    return first, parts


def _of_one_length(usable: DataFrame, size: int, rows: int, k: int, sample: int, shard_rows: int, query_rows: int) -> DataFrame:
    # bounded by `sample`: the rows with the least hashes
    picked = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toPandas()
    model = fit(np.array(picked["vector"].tolist(), np.float64), rows, k=k)
    index = stash(usable.select("vec_id", "vector").mapInArrow(_assign(model, size), "vec_id long, vector array<double>, list int, code binary"), "ann")
    counts = np.zeros(model.count, np.int64)
    for row in index.groupBy("list").count().collect():  # one row a list: sample / 8 * FINER at most
        counts[row["list"]] = row["count"]
    first, parts = shards(counts, shard_rows)
    dealt = index.withColumn("nth", F.xxhash64("vec_id")).mapInArrow(_deal(first, parts), "vec_id long, vector array<double>, list int, code binary, shard int")
    asked = usable.where(F.col("asked")).select(F.col("vec_id").alias("query_id"), "vector")
    routed = asked.mapInArrow(_route(model, size, first, parts), "query_id long, vector array<double>, shard int")
    # shards to which more than query_rows queries come are searched in as many blocks
    full = stash(routed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("blocks")).where("blocks > 1"), "blocks")
    blocks = bounded(full.select(F.col("shard").alias("of"), "blocks"), 32)
    split = lambda rows: rows.join(blocks, F.col("shard") == F.col("of"), "left").drop("of").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = split(dealt).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    routed = split(routed).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
    return dealt.groupBy("shard", "block").cogroup(routed.groupBy("shard", "block")).applyInArrow(_search(model, size, k), "query_id long, vec_id long, score double")


def neighbours(vectors: DataFrame, queries: Column, *, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = 20_000, shard_rows: int = 16_384, query_rows: int = 32_768) -> DataFrame:
    """The k nearest rows found of each row that `queries` selects: query_id, rank, vec_id, score (Euclidean distance)."""
    spark = vectors.sparkSession
    named = told_apart(vectors, vec_id, embedding).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"), queries.alias("asked")).where(F.col("vec_id").isNotNull())
    usable = named.where(_usable("vector"))
    # one index for each length of vectors; a table has one as a rule
    lengths = usable.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asked").cast("int")).alias("q")).where("n > 1 and q > 0").orderBy("size").collect()
    found = [_of_one_length(usable.where(F.size("vector") == r["size"]), r["size"], r["n"], k, sample, shard_rows, query_rows) for r in lengths]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return reduce(DataFrame.unionByName, found).select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
