"""Measurement tables: text with a header and columns parted by white space."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TIMES = "min double, lower double, median double, upper double, max double"
_COUNTERS = "L2_hits long, L2_miss long, L3_hits long, L3_miss long, instructions long"
# The layouts of the tables.
LAYOUTS = {
    "aligner": f"iteration int, A_len long, B_len long, {_TIMES}, mean double, `%RSD` double, A_prod long, B_prod long, A_x long, B_x long, {_COUNTERS}",
    "compression": f"num int, N long, {_TIMES}, compression double, {_COUNTERS}",
    "min_multiply": f"bcs int, N long, {_TIMES}, {_COUNTERS}",
    "max_multiply": f"N long, {_TIMES}, {_COUNTERS}",
    "sweep": "xfactor double, ffactor double, median_time double, mean_time double, RSD double",
}


def read(spark: SparkSession, paths: str | list[str], layout: str) -> DataFrame:
    """Rows of the files by the columns of a layout. The header is the line that starts with its first column."""
    fields = [x.strip().rsplit(" ", 1) for x in LAYOUTS[layout].split(",")]
    lines = spark.read.text(paths).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("v"))
    rows = lines.where((F.size("v") >= len(fields)) & (F.get("v", F.lit(0)) != fields[0][0].strip("`")))
    return rows.select(*[F.get("v", F.lit(k)).cast(kind).alias(name.strip("`")) for k, (name, kind) in enumerate(fields)])


def write(rows: DataFrame, path: str, width: int = 15) -> None:
    """One text file a table: left-aligned columns of a fixed width under a header."""
    names = rows.columns
    line = lambda cells: F.rtrim(F.concat(*[F.rpad(F.coalesce(c.cast("string"), F.lit("null")), width, " ") for c in cells]))
    spark = rows.sparkSession
    header = spark.range(1).select(line([F.lit(n) for n in names]).alias("value"))
    header.unionByName(rows.coalesce(1).select(line([F.col(f"`{n}`") for n in names]).alias("value"))).coalesce(1).write.text(path)
