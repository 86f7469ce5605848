"""Statistics of repeated measurements, and the queries on tables of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gramweave.operators.places import running

#: Statistic -> place in t sorted trials, by whole-number division.
PLACES = {"min": "0", "lower": "(n - 1) div 4", "median": "n div 2", "upper": "3 * (n - 1) div 4", "max": "n - 1"}


def trial_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """min, lower, median, upper, max (elements of the sorted trials), mean and rsd (percent) of each group.

    Trials are counted by value before they are dealt; running sums of the counts over ranges of values then tell which value
    stands at which place, so that no task gets a group.
    """
    counted = rows.groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = running(counted, by, ["v"], F.col("n"), into="k")
    mean = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), (100 * F.stddev_pop(value) / F.avg(value)).alias("rsd"))
    whole = mean.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(by)], *[F.expr(place).alias(f"_{name}") for name, place in PLACES.items()], "mean", "rsd")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(by)], F.lit(True))
    holds = lambda name: (F.col("k") <= F.col(f"_{name}")) & (F.col(f"_{name}") < F.col("k") + F.col("n"))
    picked = [F.max(F.when(holds(name), F.col("v"))).alias(name) for name in PLACES]
    return placed.join(whole, same).groupBy(*by, "mean", "rsd").agg(*picked).select(*by, *PLACES, "mean", "rsd")


def totals(stats: DataFrame, by: list[str]) -> DataFrame:
    """The sum of the stages' medians; the other statistics are 0 in a total."""
    return stats.groupBy(*by).agg(F.sum("median").alias("median")).select(*by, *[F.col("median") if c == "median" else F.lit(0.0).alias(c) for c in (*PLACES, "mean", "rsd")])


def stage_shares(stats: DataFrame, iteration: str, stage: str) -> DataFrame:
    """Each stage's share of its iteration and the shares stacked in the order of stages."""
    whole = Window.partitionBy(iteration)
    share = F.col("median") / F.sum("median").over(whole)
    stacked = whole.orderBy(stage).rowsBetween(Window.unboundedPreceding, 0)
    return stats.withColumn("share", share).withColumn("stacked", F.sum("share").over(stacked))


def speedup(base: DataFrame, other: DataFrame, iteration: str = "iteration") -> DataFrame:
    """base / other, aligned by iteration; a missing partner gives null."""
    joined = base.select(iteration, F.col("median").alias("x")).join(other.select(iteration, F.col("median").alias("y")), iteration, "left")
    return joined.select(iteration, (F.col("x") / F.col("y")).alias("speedup"))


def head(rows: DataFrame, n: int, order: str, by: list[str] | None = None, last: bool = False) -> DataFrame:
    """The first (or last) n rows in an order, all in all or of each group."""
    if not by:
        return rows.orderBy(F.desc(order) if last else F.asc(order)).limit(n)
    window = Window.partitionBy(*by).orderBy(F.desc(order) if last else F.asc(order))
    return rows.withColumn("_k", F.row_number().over(window)).where(F.col("_k") <= n).drop("_k")


def sweep_grid(spark, step: float = 0.3, most: float = 6.0, centre: float = 3.0) -> DataFrame:
    """(xfactor, ffactor, seq): the grid of factors, nearest to the centre first."""
    count = int(most / step + 1e-9)
    axis = lambda name: spark.range(1, count + 1).select(F.round(F.col("id") * step, 6).alias(name))
    grid = axis("xfactor").crossJoin(axis("ffactor"))
    away = F.round(F.pow(F.col("xfactor") - centre, 2) + F.pow(F.col("ffactor") - centre, 2), 6)
    ordered = grid.withColumn("away", away)
    return ordered.withColumn("seq", F.row_number().over(Window.orderBy("away", "xfactor", "ffactor")).cast("long")).drop("away")


def sweep_grids(rows: DataFrame, by: str, centre: Column, step: float = 0.3, most: float = 6.0) -> DataFrame:
    """(by, xfactor, ffactor, seq): for each row the grid of factors, nearest to the row's own centre first."""
    count = int(most / step + 1e-9)
    axis = F.lit([round(k * step, 6) for k in range(1, count + 1)])
    points = rows.select(by, centre.alias("_c"), F.explode(axis).alias("xfactor")).select(by, "_c", "xfactor", F.explode(axis).alias("ffactor"))
    away = F.round(F.pow(F.col("xfactor") - F.col("_c"), 2) + F.pow(F.col("ffactor") - F.col("_c"), 2), 6)
    order = Window.partitionBy(by).orderBy("_away", "xfactor", "ffactor")  # as many rows as a grid has
    return points.withColumn("_away", away).select(by, "xfactor", "ffactor", F.row_number().over(order).cast("long").alias("seq"))


def heat_map(rows: DataFrame, down: str, across: str, value: str, columns: list) -> DataFrame:
    return rows.groupBy(down).pivot(across, columns).agg(F.first(value))


def table_norm(median: Column, a_prod: Column, b_prod: Column, a_x: Column, b_x: Column) -> Column:
    """Time of table building over (productions)^2 * x * log2 x."""
    x = a_x + b_x
    return median / (F.pow(a_prod + b_prod, 2) * x * F.log2(x))


def grid_norm(median: Column, n: Column, x: Column) -> Column:
    """Time of the sweep over N^2 / x."""
    return median / (F.pow(n, 2) / x)


def total_norm(median: Column, n: Column, productions: Column) -> Column:
    """Time over N * n * log2(max(N / n, 2))."""
    return median / (n * productions * F.log2(F.greatest(n / productions, F.lit(2.0))))


def miss_percent(hits: Column, misses: Column) -> Column:
    return 100 * misses / (hits + misses)


def compression_norm(productions: Column, number: Column, n: Column) -> tuple[Column, Column]:
    """productions / (number + 2), and that over log2 N."""
    return productions / (number + 2), productions / (number + 2) / F.log2(n)


def base_case_size(n: Column, base: int = 50) -> Column:
    """N / 2 ^ ceil(log2(N / base))."""
    return n / F.pow(F.lit(2.0), F.ceil(F.log2(n / base)))


def theory_ratio(simple: Column, compressed: Column, n: Column) -> Column:
    """The measured speed-up over N / log2(N) ^ 2.5."""
    return (simple / compressed) / (n / F.pow(F.log2(n), F.lit(2.5)))
