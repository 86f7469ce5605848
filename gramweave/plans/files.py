"""Queries on files: sequences and measurements, written and read again; and staged runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramweave.plans import staged
from gramweave.plans.distances import PAIRS, part_pairs, table
from gramweave.sources import fasta, measurements
from gramweave.sources import fasta_format as fasta_format_source
from gramweave.sources.scratch import scratch_path


def _sequences(spark, sf_dir) -> str:
    """A conversation a record: its turns, whose line ends become comments, are the lines of its sequence."""
    turns = table(spark, sf_dir, "conversations").withColumn("value", F.regexp_replace("text", "\n", "\n;"))
    own = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "value"))), lambda x: x["value"]), "\n").alias("body"))
    path = scratch_path(spark, "sequences")
    own.select(F.concat(F.lit(">"), F.col("conv_id").cast("string"), F.lit("\n"), "body").alias("value")).repartition(2).write.text(path)
    return path


def fasta_files(spark, sf_dir):
    """Sequence files read whole."""
    return fasta.read(spark, _sequences(spark, sf_dir)).select("name", "seq")


def fasta_split(spark, sf_dir):
    """The same files, split over tasks."""
    return fasta.read_split(spark, _sequences(spark, sf_dir)).select("name", "seq")


def fasta_written(spark, sf_dir):
    """Passages written as records in lines of 70 characters, and read again."""
    path = scratch_path(spark, "records")
    fasta.write(table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.translate("text", " \n", "__").alias("seq")), path)
    return fasta.read(spark, path).select("name", "seq")


def fasta_format(spark, sf_dir):
    """Conversations written as records by the format's writer, and read by ranges of 4096 bytes, of which records cover several."""
    fasta_format_source.register(spark)
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("name"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "")
    path = scratch_path(spark, "format")
    turns.agg(F.translate(body, " \n\r>;", "_").alias("seq")).write.format("fasta").mode("append").save(path)
    return spark.read.format("fasta").option("rangeBytes", 4096).load(path).select("name", "seq")


def measurement_files(spark, sf_dir):
    """Order statistics of quantities by line number, written as a measurement table and read again."""
    from gramweave.operators import trials

    stats = trials.trial_stats(table(spark, sf_dir, "lineitem"), ["l_linenumber"], "l_quantity")
    counters = [F.lit(k).alias(name) for k, name in enumerate(("L2_hits", "L2_miss", "L3_hits", "L3_miss", "instructions"))]
    path = scratch_path(spark, "measurements")
    measurements.write(stats.select(F.col("l_linenumber").alias("N"), "min", "lower", "median", "upper", "max", *counters), path)
    return measurements.read(spark, path, "max_multiply")


#: Trials of the staged runs.
TRIALS = 2


def _shown(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, "engine", "size", "trial", "stage", "outcome", (F.col("seconds") >= 0).alias("timed"))


def staged_distances(spark, sf_dir):
    """Stages of both engines over names and types of parts, with the distance that the last stage found."""
    pairs = part_pairs(spark, sf_dir).where("char_length(a) > 0 AND char_length(b) > 0").select("a", "b", (F.char_length("a") + F.char_length("b")).alias("size"))
    engines = {"plain": staged.plain_stages(), "grammar": staged.grammar_stages(0.4, 2.0)}
    runs = [staged.run(pairs, name, stages, lambda row: (row["a"], row["b"]), ("a", "b"), TRIALS, outcome=int) for name, stages in engines.items()]
    return _shown(reduce(DataFrame.unionByName, runs), "a", "b")


def staged_kernels(spark, sf_dir):
    """Runs of compression over turns, of products over the orders of customers, and of both vector products over pairs of parts; outcomes:
    the length that a grammar spells, how many columns a product has, and the last value of a vector."""
    turns = table(spark, sf_dir, "conversations").where("char_length(text) > 0").select(F.concat_ws("-", "conv_id", "turn").alias("of"), "text", F.char_length("text").alias("size"))
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("x"))
    place = lambda key: F.transform(F.array_sort(F.transform("x", lambda v: v["o_orderkey"])), lambda k: F.array_position(F.transform(F.array_sort(F.transform("x", lambda v: F.struct(key(v), v["o_orderkey"].alias("k")))), lambda v: v["k"]), k) - 1)
    products = orders.select(F.col("o_custkey").cast("string").alias("of"), place(lambda v: v["o_totalprice"].alias("s")).alias("p"), place(lambda v: (-v["o_totalprice"]).alias("s")).alias("q"), F.size("x").alias("size"))
    pairs = part_pairs(spark, sf_dir).where("char_length(a) > 0 AND char_length(b) > 0").select(F.concat_ws("|", "a", "b").alias("of"), "a", "b", (F.char_length("a") + F.char_length("b")).alias("size"))
    runs = [
        staged.run(turns, "compression", staged.compression_stages(), lambda row: row["text"], ("of",), TRIALS, outcome=lambda g: len(g.text())),
        staged.run(products, "product", staged.product_stages(), staged.product_of, ("of",), TRIALS, outcome=lambda p: len(set(p.tolist()))),
        *[staged.run(pairs, name, staged.vector_stages(fast), staged.vector_of, ("of",), TRIALS, outcome=lambda v: v[-1]) for name, fast in (("vector", True), ("vector_naive", False))],
    ]
    return _shown(reduce(DataFrame.unionByName, runs), "of")


def staged_factors(spark, sf_dir):
    """The grammar engine timed over a part of the grid of factors for names and types of parts, with the distances that it found."""
    from gramweave.operators import trials

    pairs = part_pairs(spark, sf_dir).where("char_length(a) > 0 AND char_length(b) > 0")
    found = staged.sweep_factors(pairs, trials.sweep_grid(spark, step=3.0), trials=1)
    return found.select("a", "b", "xfactor", "ffactor", F.col("trial").cast("long").alias("trial"), (F.col("seconds") >= 0).alias("timed"), "distance")


QUERIES = {f.__name__: f for f in (fasta_files, fasta_split, fasta_written, fasta_format, measurement_files, staged_distances, staged_kernels, staged_factors)}

SEQUENCES = r"""SELECT conv_id::VARCHAR AS name, string_agg(replace(split_part(text, chr(10), 1), ' ', ''), '' ORDER BY turn) AS seq FROM conversations GROUP BY conv_id"""
TRIAL = f"(SELECT unnest(range(0, {TRIALS}))::INT AS trial)"

ORACLES = {
    "fasta_files": SEQUENCES,
    "fasta_split": SEQUENCES,
    "fasta_written": "SELECT item_id::VARCHAR AS name, translate(text, ' ' || chr(10), '__') AS seq FROM benchmark",
    "fasta_format": "SELECT conv_id::VARCHAR AS name, translate(string_agg(text, '' ORDER BY turn), ' ' || chr(10) || chr(13) || '>;', '_') AS seq FROM conversations GROUP BY conv_id",
    "measurement_files": """SELECT l_linenumber::BIGINT AS "N", v[1]::DOUBLE AS "min", v[(n - 1) // 4 + 1]::DOUBLE AS lower, v[n // 2 + 1]::DOUBLE AS median, v[3 * (n - 1) // 4 + 1]::DOUBLE AS upper, v[n]::DOUBLE AS "max",
      0::BIGINT AS "L2_hits", 1::BIGINT AS "L2_miss", 2::BIGINT AS "L3_hits", 3::BIGINT AS "L3_miss", 4::BIGINT AS instructions
      FROM (SELECT l_linenumber, list_sort(list(l_quantity)) AS v, count(*) AS n FROM lineitem GROUP BY l_linenumber)""",
    "staged_distances": f"""SELECT a, b, engine, length(a) + length(b) AS size, trial, stage, CASE WHEN stage IN ('computation', 'grid') THEN levenshtein(a, b) END::BIGINT AS outcome, true AS timed
      FROM ({PAIRS}), (SELECT unnest([{{'engine': 'plain', 'stage': 'computation'}}, {{'engine': 'grammar', 'stage': 'grammars'}}, {{'engine': 'grammar', 'stage': 'tables'}}, {{'engine': 'grammar', 'stage': 'grid'}}], recursive := true)), {TRIAL}""",
    "staged_kernels": f"""SELECT "of", engine, size, trial, split_part(engine, '_', 1) AS stage, outcome, true AS timed FROM (
      SELECT conv_id || '-' || turn AS "of", 'compression' AS engine, length(text) AS size, length(text) AS outcome FROM conversations WHERE length(text) > 0
      UNION ALL SELECT o_custkey::VARCHAR, 'product', count(*), count(*) FROM orders GROUP BY o_custkey
      UNION ALL SELECT a || '|' || b, engine, length(a) + length(b), 3 * length(a) + 2 * length(b) FROM ({PAIRS}), (SELECT unnest(['vector', 'vector_naive']) AS engine)), {TRIAL}""",
    "staged_factors": f"SELECT a, b, 3.0::DOUBLE * x AS xfactor, 3.0::DOUBLE * y AS ffactor, 0::BIGINT AS trial, true AS timed, levenshtein(a, b)::BIGINT AS distance FROM ({PAIRS}), (SELECT unnest(range(1, 3))::DOUBLE AS x), (SELECT unnest(range(1, 3))::DOUBLE AS y)",
}
