"""What the operators of this subpackage share: scratch tables and Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramweave.sources.scratch import scratch_path

#: For each `cleared` block that is open, the tables written in it.
_open: list[list[DataFrame]] = []


def stash(df: DataFrame, tag: str, codec: str = "zstd", options: dict | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage there; options are those of the writer."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.options(**(options or {})).option("compression", codec).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stash_path = path
    for tables in _open:
        tables.append(back)
    return back


def drop_stash(*tables: DataFrame) -> None:
    """Delete written tables that nothing lazy reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stash_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def cleared() -> Iterator[None]:
    """Delete all tables that operators write inside of the block when it ends: for callers who have written their results by then."""
    _open.append([])
    try:
        yield
    finally:
        drop_stash(*_open.pop())


#: Bytes of a counted table that is broadcast at most.
BROADCAST_BYTES = 32 << 20


def bounded(df: DataFrame, width: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A side of a join: broadcast if its counted rows of `width` bytes stay in the limit, else merged."""
    return F.broadcast(df) if df.count() * width <= limit else df.hint("merge")


def plain(docs: DataFrame) -> DataFrame:
    """doc_id as long and text with null as the empty string; extra columns go, whatever their names."""
    return picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def column(df: DataFrame, name: str) -> str | None:
    """Of columns with numbers for names (`numbered`), the one that was the first of a name."""
    exact = [k for k, c in enumerate(df.columns) if c == name] or [k for k, c in enumerate(df.columns) if c.lower() == name.lower()]
    return f"_{exact[0]}" if exact else None


def numbered(df: DataFrame) -> DataFrame:
    """The columns with numbers for names: whatever they are called, they clash with none of an operator's own."""
    return df.toDF(*[f"_{k}" for k in range(len(df.columns))])


def picked(df: DataFrame, *names: str) -> DataFrame:
    """Some columns by name, whatever stands beside them (the first of names that differ by case only); one that isn't there is null."""
    at = [column(df, name) for name in names]
    return numbered(df).select(*[(F.col(k) if k else F.lit(None).cast("string")).alias(name) for k, name in zip(at, names, strict=True)])


def told_apart(df: DataFrame, *wanted: str) -> DataFrame:
    """The table with one column of each name, if case doesn't count: one that is wanted as it is spelt, else the first."""
    names = {}
    for name in (*wanted, *df.columns):
        names.setdefault(name.lower(), name)
    return picked(df, *[name for name in names.values() if column(df, name)])


def beside(df: DataFrame, keep: tuple[str, ...], text: str, run, found: list[tuple[str, str]]) -> DataFrame:
    """The kept columns and what `run` makes of batches of them with the text behind: its last columns take the text's place."""
    rows = numbered(df)
    rows = rows.select(*[F.col(column(df, c)).alias(f"_{k}") for k, c in enumerate(keep)], F.col(column(df, text)).cast("string").alias("text"))
    schema = ", ".join([*(f"{name} {kind}" for name, kind in rows.dtypes[:-1]), *(f"found{k} {kind}" for k, (_, kind) in enumerate(found))])
    return rows.mapInArrow(run, schema).toDF(*keep, *[name for name, _ in found])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Smaller Arrow batches, which bound what is held as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sample_edge(hashes: DataFrame, rows: int, sample: int) -> int:
    """A bound of `h` that `sample` distinct hashes at least do not exceed (all, if there are no more), and few times as many.

    The share of the rows' count is enough unless many rows are equal; then the bound widens eightfold until it is.
    """
    share = 1.3 * sample / max(rows, 1) + 1e-12
    while share < 1:
        edge = int(-(2**63) + share * (2**64 - 1))
        if hashes.where(F.col("h") <= F.lit(edge)).select("h").distinct().count() >= sample:
            return edge
        share *= 8
    return 2**63 - 1
