"""Running sums and places over a total order, of which no task sees more than a range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gramweave.sources.scratch import written

#: Rows of a range, where a caller knows how many there are.
RANGE = 1 << 18


def ranges(spark: SparkSession) -> int:
    """Ranges that rows are dealt in at least."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], weight: Column | None = None, into: str = "before", parts: int | None = None) -> DataFrame:
    """The rows with the sum of the weights (1 each) of all rows of the same key before theirs; ties in any order.

    The rows are dealt in ranges of key and order, so a hot key lies in many ranges. A range's sum goes to a small table whose
    running sums are the ranges' starts; within a key's part of a range a window does the rest. The dealt rows are a written table
    (`written_to` of the result), as a range must not be drawn twice. Places of all rows together are numbers that they are written with.
    """
    spark = rows.sparkSession
    parts = parts or ranges(spark)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    if not by and weight is None:
        return _numbered(rows, order, into, parts)
    weight = F.lit(1).cast("long") if weight is None else weight
    dealt = written(rows.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    at = F.struct(*by, "_range").alias("_at")  # one key, in which nulls are equal: the join and the window deal the rows once
    sums = dealt.groupBy(*by, "_range").agg(F.sum(weight).alias("_sum"))
    starts = sums.select(at, (F.sum("_sum").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_sum")).alias("_start"))
    kept = dealt.select("*", at)
    if parts > ranges(spark):  # else a task would get the rows of several ranges
        kept, starts = kept.repartition(parts, "_at"), starts.repartition(parts, "_at")
    own = F.sum(weight).over(Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    found = kept.join(starts, "_at").select(*rows.columns, (F.col("_start") + F.coalesce(own, F.lit(0))).alias(into))
    found.written_to = dealt.written_to
    return found


def _numbered(rows: DataFrame, order: list[Column], into: str, parts: int) -> DataFrame:
    """The rows with their places: ranges are written in order with the number of each row in its range, so they are dealt once."""
    low = (1 << 33) - 1  # monotonically_increasing_id has the partition above the number within it
    dealt = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    at = F.shiftright("_at", 33).alias("_range")
    counts = dealt.groupBy(at).agg(F.count(F.lit(1)).alias("_sum"))
    starts = counts.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_start"))
    found = dealt.select("*", at).join(F.broadcast(starts), "_range").select(*rows.columns, (F.col("_start") + F.col("_at").bitwiseAND(F.lit(low))).alias(into))
    found.written_to = dealt.written_to
    return found
