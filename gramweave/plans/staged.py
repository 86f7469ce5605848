"""Staged runs as measurements: each stage of a computation timed over trials, one row a trial.

A stage is a name and a function of the value before it; the rows feed `operators.trials`. Inputs are rows
of a table, each of which is measured where it lies, so a sweep of many inputs is spread over all tasks. Times are wall seconds
of a stage in its task; DataFrame stages are timed by writing them to a sink that keeps nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramweave.functions import grammar, seaweed, strings

Stage = tuple[str, Callable]
ROWS = "engine string, size long, trial int, stage string, seconds double, outcome long"


def _dealt(inputs: DataFrame) -> DataFrame:
    """Inputs over all cores: few rows are much work."""
    spark = inputs.sparkSession
    return inputs.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def run(inputs: DataFrame, engine: str, stages: list[Stage], make: Callable[[dict], object], keep: tuple[str, ...] = (), trials: int = 5, outcome: Callable | None = None) -> DataFrame:
    """The kept columns, then measurements of all stages over the inputs. `inputs` has a column `size`; make(row) gives the value to begin with;
    outcome: what to keep of the last stage's value, as a number."""
    kinds = dict(inputs.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), ROWS])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                for trial in range(trials):
                    at = make(row)
                    for k, (name, stage) in enumerate(stages, 1):
                        began = time.perf_counter()
                        at = stage(at)
                        took = time.perf_counter() - began
                        rows.append((*[row[c] for c in keep], engine, int(row["size"]), trial, name, took, int(outcome(at)) if outcome and k == len(stages) else None))
            found = pd.DataFrame(rows, columns=[*keep, "engine", "size", "trial", "stage", "seconds", "outcome"])
            yield found.astype({"outcome": "Int64"})

    return _dealt(inputs).mapInPandas(measure, schema)


def sink(df: DataFrame) -> DataFrame:
    """Run a DataFrame without keeping its rows."""
    df.write.format("noop").mode("overwrite").save()
    return df


def plain_stages() -> list[Stage]:
    return [("computation", lambda pair: strings.plain_distance(*pair))]


def grammar_stages(xfactor: float = 1.0, ffactor: float = 1.0, least: int = 1) -> list[Stage]:
    """Compress, build the tables of blocks, sweep the grid: the distance of one pair of texts."""

    def compress(pair):
        out = []
        for text in pair:
            g = grammar.blow_up(grammar.compressed(text))
            x = max(grammar.block_length(2 * len(text), g.productions(), xfactor, ffactor), min(least, 2 * len(text)))
            out.append([tuple(c for k in nodes for c in g.spell(k)) for _, nodes in grammar.blocks(g, x)])
        return out

    def build(sides):
        return sides, {(a, b): seaweed.table_of(a, b) for a in set(sides[0]) for b in set(sides[1])}

    def sweep(built):
        (a, b), known = built
        m, n = sum(map(len, a)), sum(map(len, b))
        found = seaweed.sweep([len(x) for x in a], [len(x) for x in b], lambda i, j, border: seaweed.applied(known[a[i], b[j]], border), np.zeros(m + 1, np.int64), np.zeros(n + 1, np.int64))
        return (m + n) // 2 - found

    return [("grammars", compress), ("tables", build), ("grid", sweep)]


def compression_stages(builder: str = "compressed") -> list[Stage]:
    return [("compression", lambda text: grammar.BUILDERS[builder](text))]


def product_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The permutations of columns p and q."""
    return np.asarray(row["p"], np.int64), np.asarray(row["q"], np.int64)


def product_stages() -> list[Stage]:
    return [("product", lambda pq: seaweed.multiply(*pq))]


def vector_of(row: dict) -> tuple[np.ndarray, seaweed.Table]:
    """A falling vector, which keeps every candidate, and the table of columns a and b."""
    table = seaweed.table_of(strings.codes(row["a"]).tolist(), strings.codes(row["b"]).tolist())
    n = table.rows + table.cols
    return 2 * (n - np.arange(n + 1)), table


def vector_stages(fast: bool = True) -> list[Stage]:
    return [("vector", lambda vt: (seaweed.vector_times_h_runs if fast else seaweed.vector_times_h)(*vt))]


def sweep_factors(pairs: DataFrame, grid: DataFrame, trials: int = 5) -> DataFrame:
    """(a, b, xfactor, ffactor, trial, seconds, distance) of the grammar engine, for each pair and point of a (small) grid of factors."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b, x, f in batch[["a", "b", "xfactor", "ffactor"]].itertuples(index=False):
                for trial in range(trials):
                    began, at = time.perf_counter(), (a, b)
                    for _, stage in grammar_stages(x, f):
                        at = stage(at)
                    rows.append((a, b, x, f, trial, time.perf_counter() - began, int(at)))
            yield pd.DataFrame(rows, columns=["a", "b", "xfactor", "ffactor", "trial", "seconds", "distance"])

    points = pairs.select("a", "b").crossJoin(F.broadcast(grid.select("xfactor", "ffactor")))
    return _dealt(points).mapInPandas(measure, "a string, b string, xfactor double, ffactor double, trial int, seconds double, distance long")
