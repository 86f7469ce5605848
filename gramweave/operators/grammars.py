"""Grammar compression of a text column: factors, productions, spelling, blocks.

Strings are independent, so a scan maps over them; a string's own compression is sequential and runs
as a kernel on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gramweave.functions import grammar
from gramweave.functions.strings import kernel
from gramweave.operators.lineage import kept

FACTORS = "array<struct<begin:long,end:long>>"
#: Rows that a task gives out at once, where a text has many.
GIVEN = 1 << 15


def _over(measure: Callable):
    """A measure over a text column; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else measure(t) for t in texts], dtype=object)

    return run


def _factors(text: str) -> list[dict]:
    return [{"begin": a, "end": b} for a, b in grammar.factorize(text)]


def _factors_automaton(text: str) -> list[dict]:
    return [{"begin": a, "end": b} for a, b in grammar.factorize_automaton(text)]


def factorize(text, method: str = "search"):
    """Column: the LZ factors as inclusive ranges; `search` and `automaton` agree."""
    return kernel(_over({"search": _factors, "automaton": _factors_automaton}[method]), FACTORS)(text)


def _rows_of(rows: DataFrame, text: str, keep: list[str], run: Callable[[str], list[list]], schema: str, given: int = GIVEN) -> DataFrame:
    """For each text the rows that run(text) has as columns of lists. A task holds the columns of one text and of `given` rows
    at most, whatever the number of texts in a batch; `given` changes nothing else. A null text has no rows."""
    asked = rows.select(*keep, F.col(text).alias("_text"))
    whole = StructType([*asked.schema.fields[:-1], *StructType.fromDDL(schema).fields])
    kinds = to_arrow_schema(whole)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(list(range(len(keep))))
            columns, origin = [[] for _ in range(len(kinds) - len(keep))], []

            def given_out(n: int) -> pa.RecordBatch:
                taken = own.take(pa.array(origin[:n], pa.int64()))
                made = [pa.array(c[:n], field.type) for c, field in zip(columns, list(kinds)[len(keep) :], strict=True)]
                for c in (origin, *columns):
                    del c[:n]
                return pa.RecordBatch.from_arrays([*taken.columns, *made], names=kinds.names)  # noqa: B023

            for k, t in enumerate(batch.column(len(keep))):
                if not t.is_valid:
                    continue
                found = run(t.as_py())
                n, at = len(found[0]), 0
                while at < n:
                    to = min(n, at + given - len(origin))
                    origin += [k] * (to - at)
                    for c, values in zip(columns, found, strict=True):
                        c += values[at:to]
                    at = to
                    if len(origin) >= given:
                        yield given_out(given)
            if origin:
                yield given_out(len(origin))

    return asked.mapInArrow(stream, whole)


def factor_rows(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row a factor: seq, begin, end."""

    def found(t: str) -> list[list]:
        factors = grammar.factorize(t)
        return [list(range(len(factors))), [a for a, _ in factors], [b for _, b in factors]]

    return _rows_of(rows, text, keep, found, "seq long, begin long, end long")


def productions(rows: DataFrame, text: str, keep: list[str], builder: str = "compressed") -> DataFrame:
    """The production table: prod_id, kind, symbol, left_id, right_id, height, len, is_root."""

    def table(t: str) -> list[list]:
        g = grammar.BUILDERS[builder](t)
        nodes = g.reached()
        left, right = [g.left[k] for k in nodes], [g.right[k] for k in nodes]
        ends = [a < 0 for a in left]
        side = lambda ids: [None if end else k for k, end in zip(ids, ends)]
        return [nodes, ["T" if end else "N" for end in ends], [g.symbol[k] for k in nodes], side(left), side(right), [g.height[k] for k in nodes], [g.size[k] for k in nodes], [k == g.root for k in nodes]]

    return _rows_of(rows, text, keep, table, "prod_id long, kind string, symbol string, left_id long, right_id long, height long, len long, is_root boolean")


def derive(table: DataFrame, keep: list[str], fold: int = 16) -> DataFrame:
    """Texts from a production table: each round spells the nodes whose children are spelt.

    Rounds follow the height, which balanced builders bound by the logarithm of the length; any other table takes
    as many as it is high. What `fold` rounds have spelt becomes one table, so that plans don't grow with the height.
    """
    table = kept(table)
    height = table.agg(F.max("height")).first()[0] or 0
    levels = [kept(table.where("kind = 'T'").select(*keep, "prod_id", F.col("symbol").alias("spelt")))]
    for level in range(1, height + 1):
        if len(levels) > fold:
            levels = [kept(reduce(DataFrame.unionByName, levels))]
        spelt = reduce(DataFrame.unionByName, levels)
        own = table.where(F.col("height") == level).select(*keep, "prod_id", "left_id", "right_id")
        left = spelt.select(*keep, F.col("prod_id").alias("left_id"), F.col("spelt").alias("l"))
        right = spelt.select(*keep, F.col("prod_id").alias("right_id"), F.col("spelt").alias("r"))
        levels.append(kept(own.join(left, [*keep, "left_id"]).join(right, [*keep, "right_id"]).select(*keep, "prod_id", F.concat("l", "r").alias("spelt"))))
    spelt = reduce(DataFrame.unionByName, levels)
    return table.where("is_root").select(*keep, "prod_id").join(spelt, [*keep, "prod_id"]).select(*keep, F.col("spelt").alias("text"))


def compression(rows: DataFrame, text: str, keep: list[str], builder: str = "compressed") -> DataFrame:
    """n_factors, n_productions, derived_len, height, ratio, blown_productions and blown_len of each text."""

    def measure(t: str) -> dict:
        factors = grammar.factorize(t)
        g = grammar.compressed(t, factors) if builder == "compressed" else grammar.BUILDERS[builder](t)
        n = g.productions()
        empty = g.root is None
        return {"n_factors": len(factors), "n_productions": n, "derived_len": len(t), "height": 0 if empty else g.height[g.root], "ratio": None if empty else n / g.size[g.root], "blown_productions": 0 if empty else grammar.blow_up(g).productions(), "blown_len": 2 * len(t)}

    schema = "struct<n_factors:long,n_productions:long,derived_len:long,height:long,ratio:double,blown_productions:long,blown_len:long>"
    return rows.select(*keep, kernel(_measured(measure), schema)(F.col(text)).alias("m")).select(*keep, "m.*")


def _measured(measure: Callable):
    """Measures as columns: of a batch's texts only the numbers are held, not a dictionary each."""

    def run(texts: pd.Series) -> pd.DataFrame:
        columns: dict[str, list] = {}
        for t in texts:
            for name, value in measure("" if t is None else t).items():
                columns.setdefault(name, []).append(value)
        return pd.DataFrame(columns)

    return run


def round_trip(text, builder: str = "compressed"):
    """Column: the text spelt by its own grammar."""

    def run(t: str) -> str:
        return grammar.BUILDERS[builder](t).text()

    return kernel(_over(run), "string")(text)


def partition(rows: DataFrame, text: str, keep: list[str], x: int | None = None, xfactor: float = 1.0, ffactor: float = 1.0) -> DataFrame:
    """Blocks in order: pos, kind, block_id (of the content), content, len, and the text's derived_len and n_productions. x: block size, else from compressibility."""

    def cut(t: str) -> list[list]:
        g = grammar.compressed(t)
        n = g.productions()
        found = grammar.blocks(g, x or grammar.block_length(len(t), n, xfactor, ffactor))
        contents = ["".join(c for k in nodes for c in g.spell(k)) for _, nodes in found]
        ids = [grammar.block_id(list(c)) for c in contents]
        return [list(range(len(found))), [kind for kind, _ in found], ids, contents, [len(c) for c in contents], [len(t)] * len(found), [n] * len(found)]

    return _rows_of(rows, text, keep, cut, "pos long, kind string, block_id string, content string, len long, derived_len long, n_productions long")


def block_size(n, productions, xfactor: float = 1.0, ffactor: float = 1.0, direct: bool = False) -> Column:
    """Column: block size of n symbols (in the subsequence route those of the blown-up text) from the productions of
    their grammar; of the direct route it may be 0, of the other it is 1 at least."""
    n = F.col(n) if isinstance(n, str) else n
    f = F.greatest(F.lit(2.0), ffactor * n / F.greatest(F.lit(1), F.col(productions) if isinstance(productions, str) else productions))
    x = F.greatest(f / F.sqrt(F.log2(f)), F.least(F.lit(5), n).cast("double"))
    return F.greatest(F.lit(0 if direct else 1).cast("long"), F.least(F.floor(x * xfactor), n.cast("long")))


def dot(text, folded: bool = True, builder: str = "compressed"):
    """Column: the grammar as GraphViz text."""

    def run(t: str) -> str:
        return grammar.to_dot(grammar.BUILDERS[builder](t), folded)

    return kernel(_over(run), "string")(text)
