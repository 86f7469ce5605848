"""Language identification by a string kernel: which n-grams two texts share.

The blended-spectrum presence kernel of two texts is the number of distinct 1- to 4-grams (hashed
to 2^18 cells, letters in lower case, any other character as a blank) in both, over the root of
the product of their counts. Nyström landmarks, some documents of each language, stand for the
training set; one-versus-rest kernel ridge regression is solved in their span. Scoring is two
matrix products a batch: presence x landmarks, then kernel values x coefficients.

Fitted on a bounded sample: at most `per_language` different labelled rows of each language (those with the
least hash of doc_id and text; equal rows count once) and at most `most` in all, of which `landmarks` a language
are landmarks. Prediction reads every whole text.

Defined cases: null text or text without a letter is `und` with score 0, as is everything if no
row can be learnt from; a null doc_id is held out; rows without lang teach nothing; ties go to
the language that sorts first; rows of equal doc_id are predicted one by one; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gramweave.operators.spread import spread

from ._base import beside, bounded, drop_stash, picked, slices, stash

CELLS = 1 << 18
LONGEST = 4
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


class Grams:
    """Distinct n-gram cells of texts, one scratch table for all."""

    def __init__(self):
        self.seen = np.zeros(CELLS, bool)

    def cells(self, text: str | None) -> np.ndarray | None:
        """Cells in ascending order; None if there is no letter."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        known = letters()[points]
        if not known.any():
            return None
        points = np.concatenate([[32], np.where(known, points, 32), [32]]).astype(np.uint32)
        self.seen[:] = False
        mixed = rolled = points * np.uint32(0x9E3779B1)
        for n in range(LONGEST):
            if n:
                rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + mixed[n:]
            if not len(rolled):
                break
            self.seen[(rolled * np.uint32(0xC2B2AE35 + 2 * n)) >> np.uint32(14)] = True
        return np.flatnonzero(self.seen)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    column: np.ndarray  # cell -> column of the landmark matrix, -1 if no landmark has it
    landmarks: np.ndarray  # columns x landmarks, each landmark over the root of its count
    coefficients: np.ndarray  # landmarks x languages

    def presence(self, found: list[np.ndarray]) -> np.ndarray:
        """Rows of 1 over the root of the count where a cell is present."""
        out = np.zeros((len(found), self.landmarks.shape[0]), np.float32)
        for row, cells in zip(out, found):
            columns = self.column[cells]
            row[columns[columns >= 0]] = len(cells) ** -0.5
        return out

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        return (self.presence(found) @ self.landmarks).astype(np.float64) @ self.coefficients


def fit(rows: list[tuple[str, np.ndarray]], landmarks: int = 24, ridge: float = 1e-2) -> Model | None:
    """From (language, cells) of the sample, in a fixed order."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    chosen: list[np.ndarray] = []
    for lang in languages:  # richer texts stand for more: the landmarks are those of middling size and above
        own = sorted((cells for name, cells in rows if name == lang), key=len)
        chosen += [own[k] for k in np.unique(np.linspace(len(own) // 3, len(own) - 1, landmarks).astype(int))]
    used = np.unique(np.concatenate(chosen))
    column = np.full(CELLS, -1, np.int32)
    column[used] = np.arange(len(used))
    matrix = np.zeros((len(used), len(chosen)), np.float32)
    for k, cells in enumerate(chosen):
        matrix[column[cells], k] = len(cells) ** -0.5
    model = Model(languages, column, matrix, np.zeros((len(chosen), len(languages))))
    gram = np.zeros((len(chosen), len(chosen)))
    target = np.zeros((len(chosen), len(languages)))
    for at in range(0, len(rows), 64):
        part = rows[at : at + 64]
        kernel = (model.presence([c for _, c in part]) @ matrix).astype(np.float64)
        wanted = np.array([[1.0 if name == lang else -1.0 for lang in languages] for name, _ in part])
        gram += kernel.T @ kernel
        target += kernel.T @ wanted
    inner = (matrix.T @ matrix).astype(np.float64)
    solved = np.linalg.solve(gram + ridge * inner + 1e-6 * np.eye(len(chosen)), target)
    return Model(languages, column, matrix, solved)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _sample_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in slices(batches):
        found = [grams.cells(t) for t in batch.column(2).to_pylist()]
        kept = [k for k, cells in enumerate(found) if cells is not None]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), batch.column(1).take(pa.array(kept, pa.int64())), pa.array([found[k].astype(np.int32).tobytes() for k in kept], pa.binary())], names=["h", "lang", "cells"])


def train(docs: DataFrame, per_language: int = 300, landmarks: int = 24, most: int = 20_000) -> Model | None:
    """Learn from text and lang of rows that are not held out."""
    docs, doc_id = picked(docs, "doc_id", "text", "lang"), F.col("doc_id").cast("long")
    labelled = docs.where(F.col("lang").isNotNull() & doc_id.isNotNull() & ~held_out(doc_id)).select(F.col("lang").cast("string").alias("lang"), F.xxhash64(doc_id, F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    counts = stash(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    each = min(per_language, max(1, most // max(1, counts.count())))
    # about four times as many rows of each language as are wanted have a hash below its edge; where many rows
    # are equal the edge widens eightfold until enough different ones have
    shares = counts.select(F.col("lang").alias("of"), (F.lit(4.0 * each) / F.col("n")).alias("share"))
    while True:
        edge = F.when(F.col("share") >= 0.5, F.lit(2**63 - 1)).otherwise((F.col("share") * 2.0**64 - 2.0**63).cast("long"))
        edges = bounded(shares.withColumn("edge", edge), 64)
        low = stash(labelled.select("lang", "h").join(edges, F.col("lang") == F.col("of")).where("h <= edge").select("lang", "h").distinct(), "low")
        tally = bounded(low.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), 64)
        short = (F.coalesce("n", F.lit(0)) < each) & (F.col("share") < 0.5)
        found = stash(shares.join(tally, F.col("of") == F.col("lang"), "left").select("of", "share", short.alias("short")), "shares")
        if found.where("short").isEmpty():
            break
        drop_stash(low)
        shares = found.select("of", F.when(F.col("short"), F.col("share") * 8).otherwise(F.col("share")).alias("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    # bounded by `most`: hashes without their texts
    chosen = low.select("lang", "h", rank.alias("nth")).where(F.col("nth") <= each).select("lang", "h")
    sample = labelled.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).select("h", "lang", "text").mapInArrow(_sample_cells, "h long, lang string, cells binary")
    rows = sorted((r.lang, r.h, bytes(r.cells)) for r in sample.collect())
    return fit([(lang, np.frombuffer(cells, np.int32)) for lang, _, cells in rows], landmarks)


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in slices(batches, 128):
            n = batch.num_rows
            found = [grams.cells(t) for t in batch.column(batch.num_columns - 1).to_pylist()] if model else [None] * n
            names, score = [UNKNOWN] * n, [0.0] * n
            if kept := [k for k, cells in enumerate(found) if cells is not None]:
                values = model.scores([found[k] for k in kept])
                shares = np.exp(4 * (values - values.max(1, keepdims=True)))
                shares /= shares.sum(1, keepdims=True)
                for k, best, share in zip(kept, values.argmax(1).tolist(), shares.max(1).tolist()):
                    names[k], score[k] = model.languages[best], round(share, 6)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "name", "score"])

    return run


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The kept columns of every row, then the predicted language and its score; kept columns may have any names."""
    return beside(docs, keep, text, _predict(model), [(into[0], "string"), (into[1], "double")])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = identify(picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
