"""Synthetic strings, each a DataFrame."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "acgt"
# The seeds and the growth of lengths.
STREAM_SEED, STRING_SEED, GROWTH = 0xDEADBEEF, 0xCAFEBABE, 1.7


def fibonacci(spark: SparkSession, to: int) -> DataFrame:
    """(n, text) for n = 0..to: "", a, ab, then each the concatenation of the two before it."""
    rows = spark.sql(f"""
      WITH RECURSIVE f(n, text, following) MAX RECURSION LEVEL {to + 2} AS (
        SELECT 0L, '', 'a' UNION ALL
        SELECT n + 1, following, CASE WHEN n = 0 THEN 'ab' ELSE concat(following, text) END FROM f WHERE n < {to})
      SELECT n, text FROM f""")
    return rows.coalesce(1)


def fibonacci_text(n: Column, first: Column | str = "a", second: Column | str = "b") -> Column:
    """The n-th Fibonacci string of two letters: "", a, ab, then each the concatenation of the two before it."""
    a, b = (c if isinstance(c, Column) else F.lit(c) for c in (first, second))
    state = lambda text, following: F.struct(text.alias("text"), following.alias("following"))
    step = lambda s, k: state(s["following"], F.when(k == 1, F.concat(a, b)).otherwise(F.concat(s["following"], s["text"])))
    return F.when(n <= 0, F.lit("")).otherwise(F.aggregate(F.sequence(F.lit(1), n.cast("int")), state(F.lit(""), a), step, lambda s: s["text"]))


def fibonacci_source(spark: SparkSession, to: int) -> DataFrame:
    """The strings that a run up to `to` yields: numbers 2 to `to` + 1."""
    return fibonacci(spark, to + 1).where("n >= 2")


def periodic(length: Column | int, alphabet: str = ALPHABET) -> Column:
    """The alphabet over and over, cut to a length."""
    n = length if isinstance(length, Column) else F.lit(length)
    times = F.ceil(n / len(alphabet)).cast("int")
    return F.when(n <= 0, F.lit("")).otherwise(F.substring(F.repeat(F.lit(alphabet), times), F.lit(1), n.cast("int")))


def random_text(length: Column | int, seed: Column | int = STRING_SEED, alphabet: str = ALPHABET) -> Column:
    """Uniform characters from a hash of seed and place: of one seed, a shorter text is a prefix of a longer one."""
    n = length if isinstance(length, Column) else F.lit(length)
    s = seed if isinstance(seed, Column) else F.lit(seed)
    letters = F.array(*map(F.lit, alphabet))
    pick = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.get(letters, F.pmod(F.xxhash64(s, i), F.lit(len(alphabet))).cast("int")))
    return F.when(n <= 0, F.lit("")).otherwise(F.array_join(pick, ""))


def growing_lengths(most: int, growth: float = GROWTH) -> list[int]:
    """Lengths below a bound: 1, then grown by the factor, one more at least."""
    out, at = [], 1
    while at < most:
        out.append(at)
        at = max(ceil(at * growth), at + 1)
    return out


def random_stream(spark: SparkSession, most: int, growth: float = GROWTH, alphabet: str = ALPHABET, seed: int = STREAM_SEED) -> DataFrame:
    """(len, text): one text a length, none a prefix of another, as from one running stream."""
    rows = spark.createDataFrame([(n,) for n in growing_lengths(most, growth)], "len long")
    return rows.withColumn("text", random_text(F.col("len"), F.xxhash64(F.lit(seed), F.col("len")), alphabet))


def stream_texts(rows: DataFrame, length: str, key: str, alphabet: str = ALPHABET, seed: int = STREAM_SEED) -> DataFrame:
    """The rows with a text each of its own length, as from one running stream: a key's text is a prefix of no other one's."""
    return rows.withColumn("text", random_text(F.col(length), F.xxhash64(F.lit(seed), F.col(key)), alphabet))


def prefixes(rows: DataFrame, text: str, most: int, keep: list[str], growth: float = GROWTH) -> DataFrame:
    """Growing prefixes (len, prefix) of each text cut to `most`: all lengths below its own."""
    whole = F.substring(F.col(text), 1, most)
    table = F.lit(growing_lengths(most, growth)).cast("array<long>")
    size = F.char_length(whole)
    found = rows.select(*keep, whole.alias("_t"), F.explode(F.filter(table, lambda n: n < size)).alias("len"))
    return found.select(*keep, "len", F.substring(F.col("_t"), F.lit(1), F.col("len").cast("int")).alias("prefix"))
