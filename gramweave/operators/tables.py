"""Boundary-transfer tables in rows: cells, merges, applications, and products as array columns.

A permutation table is struct<rows, cols, perm>; merges and products run as kernels over Arrow
batches, one row a table, so many tables merge in parallel. Vertical merging is associative, so a long
column of tables reduces in rounds of neighbours.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramweave.functions import seaweed
from gramweave.functions.strings import kernel

TABLE = "struct<rows:long,cols:long,perm:array<long>>"


def cell(a: Column, b: Column) -> Column:
    """The table of two single characters."""
    perm = F.when(a == b, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(0))).cast("array<long>")
    return F.struct(F.lit(1).cast("long").alias("rows"), F.lit(1).cast("long").alias("cols"), perm.alias("perm"))


def cell_h(a: Column, b: Column) -> Column:
    """The 3 x 3 H table of two single characters."""
    eq = (a == b).cast("long")
    row = lambda *v: F.array(*[x if isinstance(x, Column) else F.lit(x).cast("long") for x in v])
    return F.array(row(1, 1, 1), row(0, eq, 1), row(-1, 0, 1))


def cell_distance(a: Column, b: Column) -> Column:
    """The 3 x 3 distance table of two single characters; null is infinity."""
    ne = (a != b).cast("long")
    row = lambda *v: F.array(*[x if isinstance(x, Column) else F.lit(x).cast("long") for x in v])
    return F.array(row(0, 1, None), row(1, ne, 1), row(None, 1, 0))


def _struct(t: seaweed.Table) -> dict:
    return {"rows": t.rows, "cols": t.cols, "perm": t.perm.tolist()}


def _read(row) -> seaweed.Table:
    return seaweed.Table(int(row["rows"]), int(row["cols"]), np.asarray(row["perm"], np.int64))


def _merge(merger):
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_struct(merger(_read(x), _read(y))) for x, y in zip(a.to_dict("records"), b.to_dict("records"))], columns=["rows", "cols", "perm"])

    return kernel(run, TABLE)


def stack(top, bottom) -> Column:
    """Column: the table of the upper and the lower string over one string across."""
    return _merge(seaweed.stacked)(top, bottom)


def beside(left, right) -> Column:
    """Column: the table of one string over the left and the right string across."""
    return _merge(seaweed.beside)(left, right)


def product(p, q) -> Column:
    """Column: the unit-Monge product of two permutations."""

    def run(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([seaweed.multiply(np.asarray(x, np.int64), np.asarray(y, np.int64)).tolist() for x, y in zip(p, q)], dtype=object)

    return kernel(run, "array<long>")(p, q)


def build(a, b) -> Column:
    """Column: the table of two non-empty strings."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_struct(seaweed.table_of(list(x), list(y))) for x, y in zip(a, b)], columns=["rows", "cols", "perm"])

    return kernel(run, TABLE)(a, b)


def apply(table, border) -> Column:
    """Column: a table's outputs from its inputs."""

    def run(table: pd.DataFrame, border: pd.Series) -> pd.Series:
        return pd.Series([seaweed.applied(_read(t), np.asarray(v, np.int64)).tolist() for t, v in zip(table.to_dict("records"), border)], dtype=object)

    return kernel(run, "array<long>")(table, border)


def _nested(m: np.ndarray) -> list:
    """Rows of a dense table; infinity is null."""
    return [[None if v >= seaweed.FAR else int(v) for v in row] for row in m]


def _dense(rows) -> np.ndarray:
    return np.array([[seaweed.FAR if v is None or v != v else int(v) for v in row] for row in rows], np.int64)


NESTED = "array<array<long>>"


def build_distance(a, b) -> Column:
    """Column: the dense distance table of two non-empty strings."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_nested(seaweed.distance_table_of(list(x), list(y))) for x, y in zip(a, b)], dtype=object)

    return kernel(run, NESTED)(a, b)


def build_h(a, b) -> Column:
    """Column: the dense H table of two non-empty strings."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([seaweed.h_of(seaweed.table_of(list(x), list(y))).tolist() for x, y in zip(a, b)], dtype=object)

    return kernel(run, NESTED)(a, b)


#: Kind of dense table -> (vertical merge by columns, horizontal merge by rows).
MERGERS = {"distance": (seaweed.distance_stacked, seaweed.distance_beside), "h": (seaweed.h_stacked, seaweed.h_beside)}


def merge_dense(first, second, shared, kind: str = "distance", vertical: bool = True) -> Column:
    """Column: two dense tables merged; shared: the length of the string that both have."""
    merge = MERGERS[kind][0 if vertical else 1]

    def run(first: pd.Series, second: pd.Series, shared: pd.Series) -> pd.Series:
        return pd.Series([_nested(merge(_dense(x), _dense(y), int(n))) for x, y, n in zip(first, second, shared)], dtype=object)

    return kernel(run, NESTED)(first, second, shared)


def apply_dense(table, border, rows, kind: str = "distance") -> Column:
    """Column: a dense table's outputs from its inputs; rows: the length of the string down."""

    def one(table, border, m) -> list[int]:
        dense, border = _dense(table), np.asarray(border, np.int64)
        if kind == "distance":
            return seaweed.distance_applied(dense, border).tolist()
        return seaweed.h_applied(dense, int(m), border).tolist()

    def run(table: pd.Series, border: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([one(*values) for values in zip(table, border, rows)], dtype=object)

    return kernel(run, "array<long>")(table, border, rows)


def equals_dense(table, h) -> Column:
    """Column: whether a permutation table and a dense H table are the same table."""

    def run(table: pd.DataFrame, h: pd.Series) -> pd.Series:
        return pd.Series([bool(np.array_equal(seaweed.h_of(_read(t)), _dense(x))) for t, x in zip(table.to_dict("records"), h)])

    return kernel(run, "boolean")(table, h)


def times_h(vector, table, fast: bool = True) -> Column:
    """Column: the (max,+) product of a vector with a table's H, by runs or by the definition."""
    times = seaweed.vector_times_h_runs if fast else seaweed.vector_times_h

    def run(vector: pd.Series, table: pd.DataFrame) -> pd.Series:
        return pd.Series([times(np.asarray(v, np.int64), _read(t)).tolist() for v, t in zip(vector, table.to_dict("records"))], dtype=object)

    return kernel(run, "array<long>")(vector, table)


def _neighbours(top: pd.Series, bottom: pd.Series, a: pd.Series, b: pd.Series, cols: pd.Series) -> pd.DataFrame:
    """The table of each two neighbours; a table without one stays."""
    out = []
    for p, q, m, n, width in zip(top, bottom, a, b, cols):
        t = seaweed.Table(int(m), int(width), np.asarray(p, np.int64))
        out.append(_struct(t if q is None else seaweed.stacked(t, seaweed.Table(int(n), int(width), np.asarray(q, np.int64)))))
    return pd.DataFrame(out, columns=["rows", "cols", "perm"])


def reduce_stack(tables: DataFrame, by: list[str], place: str, table: str = "table") -> DataFrame:
    """Merge the tables of each group from the top down, in rounds of neighbours (log2 of the most tables).

    A round groups places by twos, so no group ever holds more than two tables.
    """
    rows = tables.select(*by, F.col(place).cast("long").alias("_at"), F.col(table).alias("_t"))
    most = rows.agg(F.max("_at")).first()[0] or 0
    merge = kernel(_neighbours, TABLE)
    while most:
        two = rows.groupBy(*by, F.shiftright("_at", 1).alias("_at")).agg(F.array_sort(F.collect_list(F.struct("_at", "_t"))).alias("_ts"))
        top, bottom = F.get("_ts", F.lit(0))["_t"], F.get("_ts", F.lit(1))["_t"]
        rows = two.select(*by, "_at", merge(top["perm"], bottom["perm"], top["rows"], F.coalesce(bottom["rows"], F.lit(0).cast("long")), top["cols"]).alias("_t"))
        most >>= 1
    return rows.select(*by, F.col("_t").alias(table))
