"""Quality classification from weak labels.

Heuristic labellers vote good, bad or nothing on every document. How often each pattern of votes
occurs (counted over all documents; there are 3 ** labellers patterns at most) is all that
expectation-maximisation needs to estimate the share of bad documents and, for each labeller, how it
votes on good and on bad ones. The posterior of a document's pattern is its soft label. A linear
scorer over hashed features (n-grams of character classes, and buckets of repetition statistics)
learns those posteriors by logistic regression, on at most `sample` different documents (those with the least
hash of doc_id and text; equal rows count once), and scores every whole text; documents below `least` are rejected.

Defined cases: null text, or text without a visible character, has score 0 and is rejected; text
too short for the labellers gets no vote and the scorer decides; rows of equal doc_id are
scored one by one; with no document to learn from every other text scores 1 and stays; an empty
table gives no row; extra columns stay.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramweave.operators.spread import spread

from ._base import beside, picked, sample_edge, slices

CELLS = 1 << 13
LONGEST = 6
BAD, GOOD, NONE = 0, 1, 2
#: Documents of fewer words get no vote from labellers that count words.
FEW = 8
#: Words within which the share of distinct ones is taken.
WINDOW = 1000

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point: letters in two cases, digits, blanks, and any other by itself."""
    if not _classes:
        table = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))
            if kind[0] in "LM":
                table[c] = ord("A") if kind in ("Lu", "Lt") else ord("a")
            elif kind[0] == "N":
                table[c] = ord("0")
            elif kind[0] == "Z" or c in (9, 11, 12, 13):
                table[c] = 32
        _classes.append(table)
    return _classes[0]


def _bad(value: float, bound: float) -> int:
    """A detector of one defect: bad from a bound on, else no vote."""
    return BAD if value >= bound else NONE


class Reader:
    """What labellers and scorer take from one text."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = self.text.split()
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.kinds = classes()[points]
        n = len(self.words)
        self.repeats = sum(map(eq, self.words, self.words[1:])) / (n - 1) if n > 1 else 0.0
        # by windows, as the share falls with the length of any text
        self.distinct = sum(len(set(self.words[k : k + WINDOW])) for k in range(0, n, WINDOW)) / n if n else 1.0

    def votes(self) -> list[int]:
        kinds, n = self.kinds, len(self.words)
        lower, upper = int((kinds == 97).sum()), int((kinds == 65).sum())
        seen = len(kinds) - int(((kinds == 32) | (kinds == 10)).sum())
        if not seen:
            return [NONE] * len(LABELLERS)
        plain = lower + upper + int((kinds == 48).sum()) + int(np.isin(kinds, PLAIN_MARKS).sum())
        long = n >= FEW
        proper = len(PROSE.findall(self.text)) / n
        return [
            _bad(1 - plain / seen, 0.06),
            _bad(sum(map(self.text.count, ("!!", "**", "$$", "##", "&&", "%%", "??", "~~", "=="))) / n, 0.08),
            _bad(upper / max(1, lower + upper), 0.5) if lower + upper > 20 else NONE,
            _bad(self.text.count(" | ") / n, 0.08) if n > 2 else NONE,
            _bad(len(BARE.findall(self.text)) / n, 0.1) if n > 2 else NONE,
            _bad(self.repeats, 0.2) if long else NONE,
            _bad(1 - self.distinct, 0.65) if n >= 40 else NONE,
            _bad(len(self.text) / max(1, len(zlib.compress(self.text.encode("utf-8", "surrogatepass"), 1))), 5) if n >= 40 else NONE,
            BAD if proper < 0.6 else GOOD if proper > 0.9 else NONE,
        ]

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashed features in ascending order with their weights, of length 1."""
        kinds = self.kinds
        if len(kinds) > 2:  # of a run of one class, two characters stay
            kinds = kinds[np.append([True, True], (kinds[2:] != kinds[1:-1]) | (kinds[1:-1] != kinds[:-2]))]
        total = np.zeros(CELLS, np.int64)
        rolled = kinds * np.uint32(0x9E3779B1)
        mixed = rolled
        for n in range(1, LONGEST):
            if len(rolled) < 2:
                break
            rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + mixed[n:]
            if n in (1, 2, 3, 5):
                total += np.bincount((rolled * np.uint32(0xC2B2AE35 + 2 * n)) >> np.uint32(19), minlength=CELLS)
        at = np.flatnonzero(total)
        value = np.log1p(total[at])
        value /= np.sqrt((value**2).sum()) or 1
        extra = [f"repeats {min(9, int(self.repeats * 20))}"]
        if len(self.words) >= 40:
            extra.append(f"distinct {int(self.distinct * 10)}")
        more = [xxhash.xxh32_intdigest(x) % CELLS for x in extra]
        return np.concatenate([at, more]).astype(np.int32), np.concatenate([value, [0.5] * len(more)]).astype(np.float32)


# Marks of ordinary prose, and the labellers' names in the order of their votes.
PLAIN_MARKS = np.array([ord(c) for c in ".,;:!?'\"()-–—’“”«»¿¡"], np.uint32)
LABELLERS = ("symbols", "mark_runs", "shouting", "separators", "bare_marks", "repeats", "variety", "compressed", "prose")
#: A word of ordinary prose: letters with one capital at most in front, or a number, and a mark.
PROSE = re.compile(r"(?<!\S)[\"'(«“¿¡]*(?:[^\W\d_][^\W\d_A-Z]*(?:['’-][^\W\d_]+)*|[\d.,:/-]+)[)\"'»”]*[.,;:!?]?[)\"'»”]*(?!\S)")
#: A word of marks only.
BARE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")


@dataclass(frozen=True)
class Labels:
    """The weak-label model: the share of good documents, and each labeller's votes on bad and good ones."""

    good: float
    votes: np.ndarray  # labellers x (bad, good) x (bad, good, none)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of good for rows of votes."""
        odds = np.log([1 - self.good, self.good]) + sum(np.log(self.votes[k][:, patterns[:, k]].T) for k in range(patterns.shape[1]))
        return 1 / (1 + np.exp(np.clip(odds[:, 0] - odds[:, 1], -500, 500)))


def expect_maximise(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> Labels:
    """Estimate the labellers' rates from vote patterns and their counts.

    Labellers are taken to be mostly right: one says bad of a good document at a tenth of the rate
    at most at which it says so of a bad one. That keeps a class from shrinking to the defect that
    one group of labellers sees.
    """
    labellers = patterns.shape[1]
    votes = np.zeros((labellers, 2, 3))
    votes[:, BAD], votes[:, GOOD] = [0.4, 0.2, 0.4], [0.02, 0.58, 0.4]
    model = Labels(0.8, votes)
    for _ in range(rounds):
        good = model.posterior(patterns)
        weight = np.stack([(1 - good) * counts, good * counts])
        votes = np.stack([np.stack([np.bincount(patterns[:, k], w, 3) + 0.5 for w in weight]) for k in range(labellers)])
        votes /= votes.sum(2, keepdims=True)
        most = votes[:, BAD, BAD] / 10
        over = np.maximum(votes[:, GOOD, BAD] - most, 0)
        votes[:, GOOD, BAD] -= over
        votes[:, GOOD, NONE] += over
        model = Labels(float(np.clip(weight[1].sum() / weight.sum(), 0.02, 0.98)), votes)
    return model


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, cells: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(float(self.weights[cells] @ values) + self.bias, -60, 60))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 150, rate: float = 0.3, ridge: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels: all rows in each step, Adam's step sizes."""
    sizes = np.array([len(c) for c, _ in rows])
    cells, values = np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows]).astype(np.float64)
    start, owner = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(rows)), sizes)
    # good and bad weigh alike in total
    balance = np.where(target >= 0.5, 0.5 / max(1e-9, (target >= 0.5).mean()), 0.5 / max(1e-9, (target < 0.5).mean()))
    balance /= balance.mean()
    w, first, second = np.zeros(CELLS + 1), np.zeros(CELLS + 1), np.zeros(CELLS + 1)
    for step in range(1, rounds + 1):
        z = np.add.reduceat(w[cells] * values, start) + w[-1]
        miss = balance * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target) / len(rows)
        slope = np.append(np.bincount(cells, values * miss[owner], CELLS), miss.sum()) + ridge * np.append(w[:-1], 0)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Scorer(w[:-1].astype(np.float32), float(w[-1]))


def _read(batches: Iterator[pa.RecordBatch], features: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        readers = [Reader(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        patterns = ["".join(map(str, r.votes())) for r in readers]
        columns, names = [pa.array(patterns, pa.string())], ["pattern"]
        if features:
            found = [r.cells() for r in readers]
            columns += [batch.column(0), pa.array([c.tobytes() for c, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())]
            names += ["h", "cells", "weights"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _votes(batches):
    return _read(batches, False)


def _features(batches):
    return _read(batches, True)


def train(docs: DataFrame, sample: int = 4000) -> tuple[Labels, Scorer] | None:
    """Fit on the patterns of all documents and the features of a bounded sample. `docs` has doc_id and text."""
    visible = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("h"), F.col("text").cast("string").alias("text")).where(F.length(F.trim("text")) > 0)
    # at most 3 ** labellers rows
    tally = visible.select("text").mapInArrow(_votes, "pattern string").groupBy("pattern").count().collect()
    if not tally:
        return None
    tally.sort()
    patterns = np.array([[int(c) for c in r.pattern] for r in tally])
    labels = expect_maximise(patterns, np.array([r["count"] for r in tally], np.float64))
    edge = sample_edge(visible, sum(r["count"] for r in tally), sample)
    # one row a hash, combined before the shuffle; then exactly the least `sample` of them
    few = visible.where(F.col("h") <= F.lit(edge)).groupBy("h").agg(F.first("text").alias("text")).select("h", "text")
    rows = few.mapInArrow(_features, "pattern string, h long, cells binary, weights binary").orderBy("h").limit(sample).collect()
    target = labels.posterior(np.array([[int(c) for c in r.pattern] for r in rows]))
    return labels, fit_scorer([(np.frombuffer(r.cells, np.int32), np.frombuffer(r.weights, np.float32)) for r in rows], target)


def _score(models: tuple[Labels, Scorer] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            score = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                if text is None or not text.strip():
                    score.append(0.0)
                else:
                    score.append(1.0 if models is None else round(models[1].score(*Reader(text).cells()), 6))
            kept = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def classify(docs: DataFrame, models: tuple[Labels, Scorer] | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text", into: str = "_score") -> DataFrame:
    """The kept columns of every row and `into`, the probability of a good document; kept columns may have any names."""
    return beside(docs, keep, text, _score(models), [(into, "double")])


#: Documents of a lower score are rejected.
LEAST = 0.35


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = classify(docs, train(docs), into="score")
    return found.select("doc_id", "score", (F.col("score") >= LEAST).alias("keep"))
