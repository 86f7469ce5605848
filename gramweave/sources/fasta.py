"""Sequence files.

`>` opens a record (its name is the rest of the line), `;` lines are comments, any other line is
sequence with its ASCII blanks removed. A record without sequence is dropped when another follows; the
last record of a file stays even if empty. Lines in front of the first header form a record without
name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, record, name, seq) of all files; a missing file is an error.

    Files are read whole and split into records by one regex in the JVM, so large files are one row
    each on the way; `read_split` splits a file over tasks instead.
    """
    text = spark.read.text(paths, wholetext=True)
    body = F.regexp_replace(F.col("value"), r"(?m)^;[^\n]*\n?", "")
    # a header opens a part; what stands before the first one is part 0
    parts = F.split(F.concat(F.lit("\n"), body), "\n>", -1)
    rows = text.select(F.input_file_name().alias("file"), F.posexplode(parts).alias("record", "part"), F.size(parts).alias("parts"))
    header = F.when(F.col("record") > 0, F.split_part("part", F.lit("\n"), F.lit(1))).otherwise(F.lit(""))
    sequence = F.when(F.col("record") > 0, F.expr("substring(part, char_length(split_part(part, '\n', 1)) + 1)")).otherwise(F.col("part"))
    named = rows.select("file", F.col("record").cast("long").alias("record"), "parts", header.alias("name"), F.regexp_replace(sequence, r"[\n ]", "").alias("seq"))
    last = F.col("record") == F.col("parts") - 1
    return named.where((F.length("seq") > 0) | last & (F.col("record") > 0)).select("file", "record", "name", "seq")


def _records(marked: DataFrame, order: str) -> DataFrame:
    """Records from lines with their record's number."""
    rows = marked.groupBy("file", "record").agg(
        F.coalesce(F.max(F.when(_header(), F.expr("substring(value, 2)"))), F.lit("")).alias("name"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~_header(), F.struct(order, F.regexp_replace("value", " ", "").alias("s"))))), lambda x: x["s"]), "").alias("seq"),
    )
    # a file's last record by its number alone: sequences stay where they are
    last = marked.groupBy(F.col("file").alias("_file")).agg(F.max("record").alias("_most"))
    return rows.join(last, F.col("file") == F.col("_file")).where((F.length("seq") > 0) | (F.col("record") == F.col("_most")) & (F.col("record") > 0)).select("file", "record", "name", "seq")


def _header() -> Column:
    return F.startswith("value", F.lit(">"))


def read_lines(spark: SparkSession, lines: DataFrame, order: str = "n") -> DataFrame:
    """The same records from a table of lines (file, n, value): a record's number is a running count of headers."""
    window = Window.partitionBy("file").orderBy(order)
    return _records(lines.where(~F.startswith("value", F.lit(";"))).withColumn("record", F.sum(_header().cast("long")).over(window)), order)


def read_split(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The same records, a file being split over tasks: headers are counted within each split, and the splits' counts
    are summed over the file, so that no task holds more than a split or a record."""
    at = "_metadata"
    lines = spark.read.text(paths).select(F.col(f"{at}.file_path").alias("file"), F.col(f"{at}.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"), "value").where(~F.startswith("value", F.lit(";")))
    counts = lines.groupBy("file", "split").agg(F.sum(_header().cast("long")).alias("headers"))
    before = F.coalesce(F.sum("headers").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("file", "split", before.alias("before"))
    own = F.sum(_header().cast("long")).over(Window.partitionBy("file", "split").orderBy("line"))
    marked = lines.withColumn("own", own).join(counts, ["file", "split"]).withColumn("record", F.col("before") + F.col("own"))
    return _records(marked.withColumn("n", F.struct("split", "line")), "n")


def write(rows: DataFrame, path: str, width: int = 70) -> None:
    """Records as text, the sequence in lines of a fixed width."""
    lines = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    rows.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), lines).alias("value")).write.text(path)
