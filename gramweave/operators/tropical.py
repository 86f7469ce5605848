"""Matrices as (i, j, v) rows and permutations as (r, c) rows, in relational operations.

An absent row of a matrix is infinity for the products and zero for sums. A matrix set has an id
column besides (`by`), and everything works within an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gramweave.operators.places import RANGE, ranges, running
from gramweave.sources.scratch import written

#: Questions up to which points are summed on a grid of them.
FEW = 256


def _product(a: DataFrame, b: DataFrame, best, by: list[str]) -> DataFrame:
    left = a.select(*by, F.col("i"), F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(*by, F.col("i").alias("k"), F.col("j"), F.col("v").alias("y"))
    return left.join(right, [*by, "k"]).groupBy(*by, "i", "j").agg(best(F.col("x") + F.col("y")).alias("v"))


def min_plus(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """C(i, j) = min over k of A(i, k) + B(k, j): an equi-join on k and a hash aggregate with partial minima."""
    return _product(a, b, F.min, list(by))


def max_plus(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _product(a, b, F.max, list(by))


def vector_max_plus(vector: DataFrame, matrix: DataFrame) -> DataFrame:
    """(j, value, pos): the largest v(i) + M(i, j) and the least i that gives it."""
    joined = matrix.join(vector.select("i", F.col("v").alias("x")), "i").withColumn("s", F.col("v") + F.col("x"))
    best = F.max(F.struct(F.col("s"), (-F.col("i")).alias("n")))
    return joined.groupBy("j").agg(best.alias("m")).select("j", F.col("m.s").alias("value"), (-F.col("m.n")).alias("pos"))


def submatrix(m: DataFrame, i0: int, i1: int, j0: int, j1: int) -> DataFrame:
    """Half-open ranges of rows and columns, counted from 0 again."""
    return m.where((F.col("i") >= i0) & (F.col("i") < i1) & (F.col("j") >= j0) & (F.col("j") < j1)).select((F.col("i") - i0).alias("i"), (F.col("j") - j0).alias("j"), "v")


def filled(spark, n: int, m: int, value: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i")).crossJoin(spark.range(m).select(F.col("id").alias("j"))).withColumn("v", F.lit(value).cast("long"))


def filled_each(rows: DataFrame, by: str, n: Column, m: Column, value: Column) -> DataFrame:
    """(by, i, j, v): for each row a matrix of n rows and m columns of one value."""
    to = lambda c: F.sequence(F.lit(0).cast("long"), c.cast("long") - 1)
    sized = rows.select(by, n.alias("_n"), m.alias("_m"), value.cast("long").alias("v")).where("_n > 0 AND _m > 0")
    return sized.select(by, F.explode(to(F.col("_n"))).alias("i"), "_m", "v").select(by, "i", F.explode(to(F.col("_m"))).alias("j"), "v")


def from_nested(rows: DataFrame, nested: str, keep: list[str]) -> DataFrame:
    """Cells of an array of arrays."""
    return rows.select(*keep, F.posexplode(nested).alias("i", "_r")).select(*keep, F.col("i").cast("long").alias("i"), F.posexplode("_r").alias("j", "v")).withColumn("j", F.col("j").cast("long"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, `equal`: the same cells with the same values."""
    joined = a.select("i", "j", F.col("v").alias("x")).join(b.select("i", "j", F.col("v").alias("y")), ["i", "j"], "full")
    return joined.agg(F.coalesce(F.bool_and(F.coalesce(F.col("x").eqNullSafe(F.col("y")), F.lit(False))), F.lit(True)).alias("equal"))


def dump(m: DataFrame, columns: int) -> DataFrame:
    """(i, line): each row as text, infinity for absent cells."""
    cells = F.map_from_entries(F.collect_list(F.struct(F.col("j"), F.col("v").cast("string"))))
    rows = m.where(F.col("j") < columns).groupBy("i").agg(cells.alias("c"))
    line = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: F.coalesce(F.element_at("c", j.cast("long")), F.lit("∞")))
    return rows.select("i", F.array_join(line, " ").alias("line"))


def distribution(m: DataFrame) -> DataFrame:
    """S(i, j): the sum over rows from i on and columns before j, by two running sums (one task a row, one a column)."""
    along = F.sum("v").over(Window.partitionBy("i").orderBy("j").rowsBetween(Window.unboundedPreceding, 0))
    right = m.select("i", (F.col("j") + 1).alias("j"), along.alias("v"))
    edge = m.select("i").distinct().select("i", F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("v"))
    wide = right.unionByName(edge)
    up = F.sum("v").over(Window.partitionBy("j").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0))
    above = wide.select("i", "j", up.alias("v"))
    last = m.agg(F.max("i").alias("top"))
    bottom = wide.select("j").distinct().crossJoin(F.broadcast(last)).select((F.col("top") + 1).alias("i"), "j", F.lit(0).cast("long").alias("v"))
    return above.unionByName(bottom)


def density(s: DataFrame) -> DataFrame:
    """S(i, j+1) - S(i, j) - S(i+1, j+1) + S(i+1, j), which takes a distribution back."""
    along = s.withColumn("d", F.lead("v").over(Window.partitionBy("i").orderBy("j")) - F.col("v"))
    down = F.col("d") - F.lead("d").over(Window.partitionBy("j").orderBy("i"))
    return along.withColumn("w", down).where("w is not null").select("i", "j", F.col("w").alias("v"))


def h_transform(s: DataFrame, rows: Column | int) -> DataFrame:
    """j - (i - rows) - v, its own inverse."""
    rows = rows if isinstance(rows, Column) else F.lit(rows)
    return s.withColumn("v", F.col("j") - (F.col("i") - rows) - F.col("v"))


def permutation_matrix(p: DataFrame) -> DataFrame:
    """The ones of a permutation's matrix."""
    return p.select(F.col("r").alias("i"), F.col("c").alias("j"), F.lit(1).cast("long").alias("v"))


def permutation_distribution(p: DataFrame) -> DataFrame:
    """S(i, j) = how many rows from i on have their column before j, for 0 <= i, j <= n."""
    n = F.broadcast(p.agg(F.count(F.lit(1)).alias("n")))
    dense = p.select(F.col("r").alias("i")).crossJoin(n).select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    ones = p.select(F.col("r").alias("i"), F.col("c").alias("j"), F.lit(1).cast("long").alias("one"))
    return distribution(dense.join(ones, ["i", "j"], "left").select("i", "j", F.coalesce("one", F.lit(0).cast("long")).alias("v")))


def dominance(points: DataFrame, asked: DataFrame, weight: Column | None = None) -> DataFrame:
    """The rows asked, (i, j) and more, with `count`: the points (r, c) with r >= i and c < j, or the sum of their weights.

    Rows from i on are i itself and one range of a power of two for each bit that i lacks. A point lies in one range of each power,
    so points and questions meet by range, and there running sums over the columns answer. That is a row a bit for each
    point and question, whatever the number of cells; no matrix is formed. Rows and columns are whole numbers from 0.
    """
    marks = points.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), (F.lit(1) if weight is None else weight).cast("long").alias("w"))
    asked = written(asked.withColumn("_no", F.monotonically_increasing_id()), "asked")
    top, points_n = marks.agg(F.max("r"), F.count(F.lit(1))).first()
    if (asked_n := asked.count()) ** 2 <= min(points_n, FEW**2):
        return _dominance_of_few(marks, asked)
    bits = max(1, int(top or 0).bit_length())
    level = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("level")
    held = marks.select("c", "w", "r", level).select("level", F.expr("shiftright(r, level)").alias("range"), "c", "w", F.lit(None).cast("long").alias("_no"))
    held = held.where((F.col("range") % 2 == 1) | (F.col("level") == 0))
    wanted = asked.select("_no", F.greatest(F.col("i"), F.lit(0)).cast("long").alias("i"), F.col("j").cast("long").alias("c"))
    above = wanted.select("_no", "i", "c", level).select("_no", "level", F.expr("shiftright(i, level)").alias("range"), "c")
    lacking = above.where(F.col("range") % 2 == 0).select("level", (F.col("range") + 1).alias("range"), "c", F.lit(0).cast("long").alias("w"), "_no")
    own = wanted.select(F.lit(0).alias("level"), F.col("i").alias("range"), "c", F.lit(0).cast("long").alias("w"), "_no")
    # at equal columns questions come first
    # a point has a row for each bit that it has, half of the bits in general; so has a question for each that it lacks
    parts = -(-(points_n + asked_n) * (bits + 1) // (2 * RANGE))
    summed = running(held.unionByName(lacking).unionByName(own), ["level", "range"], ["c", F.col("w") != 0, "_no"], F.col("w"), parts=max(parts, ranges(marks.sparkSession)))
    counts = summed.where("_no IS NOT NULL").groupBy("_no").agg(F.sum("before").alias("count"))
    return asked.join(counts, "_no", "left").select(*[c for c in asked.columns if c != "_no"], F.coalesce("count", F.lit(0)).alias("count"))


def _dominance_of_few(marks: DataFrame, asked: DataFrame) -> DataFrame:
    """The same where squares of the questions are no more than the points: these are summed on the grid of the rows and columns
    that are asked for, and none is moved."""
    edges = lambda name: F.array_sort(F.collect_set(F.col(name).cast("long"))).alias(f"_{name}")
    lines = F.broadcast(asked.agg(edges("i"), edges("j")))
    # edges up to a row, and up to a column
    held = marks.crossJoin(lines).select(F.size(F.filter("_i", lambda x: x <= F.col("r"))).alias("t"), F.size(F.filter("_j", lambda x: x <= F.col("c"))).alias("u"), "w")
    cells = held.groupBy("t", "u").agg(F.sum("w").alias("w"))
    at = lambda edges, name: F.array_position(edges, F.col(name).cast("long"))
    wanted = asked.crossJoin(lines).select("_no", at("_i", "i").alias("_t"), at("_j", "j").alias("_u"))
    counts = wanted.join(F.broadcast(cells), (F.col("t") >= F.col("_t")) & (F.col("u") < F.col("_u"))).groupBy("_no").agg(F.sum("w").alias("count"))
    return asked.join(counts, "_no", "left").select(*[c for c in asked.columns if c != "_no"], F.coalesce("count", F.lit(0)).alias("count"))


def inverse(p: DataFrame) -> DataFrame:
    return p.select(F.col("c").alias("r"), F.col("r").alias("c"))


def is_permutation(p: DataFrame) -> DataFrame:
    """One row, `valid`: rows and columns are both 0..n-1."""
    n = F.count(F.lit(1))
    whole = lambda c: (F.count_distinct(c) == n) & (F.coalesce(F.min(c), F.lit(0)) == 0) & (F.coalesce(F.max(c), F.lit(-1)) == n - 1)
    return p.agg((whole("r") & whole("c")).alias("valid"))


def swap(p: DataFrame) -> DataFrame:
    """The table with both strings exchanged: (n-1-r, n-1-c)."""
    n = F.broadcast(p.agg(F.count(F.lit(1)).alias("n")))
    return p.crossJoin(n).select((F.col("n") - 1 - F.col("r")).alias("r"), (F.col("n") - 1 - F.col("c")).alias("c"))


def direct_sum(p: DataFrame, q: DataFrame) -> DataFrame:
    """q behind p, with p's size as the offset."""
    n = F.broadcast(p.agg(F.count(F.lit(1)).alias("n")))
    return p.select("r", "c").unionByName(q.crossJoin(n).select((F.col("r") + F.col("n")).alias("r"), (F.col("c") + F.col("n")).alias("c")))


def unit_monge_by_definition(p: DataFrame, q: DataFrame) -> DataFrame:
    """The product of two permutations as density of the (min,+) product of their distributions: the specification."""
    found = density(min_plus(permutation_distribution(p), permutation_distribution(q)))
    return found.where("v = 1").select(F.col("i").alias("r"), F.col("j").alias("c"))
