"""Queries on grammar compression."""

from __future__ import annotations

from pyspark.sql import functions as F

from gramweave.operators import grammars
from gramweave.operators.spread import spread
from gramweave.sources import generate
from gramweave.sources.scratch import written
from gramweave.plans.distances import FIBONACCI, table


def _turns(spark, sf_dir):
    return spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))


def _names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_name").distinct()


def _texts(spark, sf_dir):
    """Names of parts and the benchmark's passages, whole."""
    return _names(spark, sf_dir).select(F.col("p_name").alias("text")).unionByName(table(spark, sf_dir, "benchmark").select("text").distinct())


def lz_factors(spark, sf_dir):
    return grammars.factor_rows(_texts(spark, sf_dir), "text", ["text"])


def lz_factors_automaton(spark, sf_dir):
    found = _texts(spark, sf_dir).select("text", F.posexplode(grammars.factorize("text", "automaton")).alias("seq", "f"))
    return found.select("text", F.col("seq").cast("long").alias("seq"), "f.begin", "f.end")


def lz_benchmark(spark, sf_dir):
    """Factors of the benchmark passages, whole: their number, and that both methods agree."""
    items = spread(table(spark, sf_dir, "benchmark")).select("item_id", grammars.factorize("text").alias("f"), grammars.factorize("text", "automaton").alias("g"))
    return items.select("item_id", F.size("f").cast("long").alias("n_factors"), (F.col("f") == F.col("g")).alias("agree"))


def lz_fibonacci(spark, sf_dir):
    """For each part the factors of a Fibonacci string, which has as many as its number says."""
    n = 1 + F.col("p_partkey") % 16
    rows = table(spark, sf_dir, "part").select("p_partkey", n.cast("long").alias("n"), generate.fibonacci_text(n).alias("text"))
    found = grammars.compression(rows, "text", ["p_partkey", "n"])
    return found.select("p_partkey", "n", "n_factors", "derived_len", "blown_len")


def slp_round_trip(spark, sf_dir):
    """Each turn spelt by its own grammar, of all three builders."""
    turns = _turns(spark, sf_dir)
    return turns.select("conv_id", "turn", *[grammars.round_trip("text", b).alias(b) for b in ("balanced", "halved", "compressed")])


def slp_derive(spark, sf_dir):
    """Names and passages spelt from the production table, level by level."""
    texts = _texts(spark, sf_dir).select(F.col("text").alias("whole"))
    return grammars.derive(grammars.productions(texts, "whole", ["whole"]), ["whole"])


def slp_balanced(spark, sf_dir):
    """Productions of the balanced tree without sharing."""
    return grammars.productions(_turns(spark, sf_dir), "text", ["conv_id", "turn"], "balanced").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_productions"), F.max("len").alias("derived_len"))


def slp_blow_up(spark, sf_dir):
    """What blowing up adds to a grammar: a production for each character used and one for the sentinel."""
    found = grammars.compression(_turns(spark, sf_dir), "text", ["conv_id", "turn"])
    return found.select("conv_id", "turn", (F.col("blown_productions") - F.col("n_productions")).alias("added"), "blown_len")


def slp_halved(spark, sf_dir):
    """Productions, height and ratio of the halved tree, whose equal parts are one production."""
    found = grammars.compression(_turns(spark, sf_dir), "text", ["conv_id", "turn"], "halved")
    return found.select("conv_id", "turn", "n_productions", "height", F.round("ratio", 9).alias("ratio"))


def compression_ratio(spark, sf_dir):
    """The compressed grammars' measures against their production tables: each pair is balanced and as high and long as
    its sides make it; productions, height and ratio are those of the table. A turn without text has no productions."""
    turns, own = _turns(spark, sf_dir), ["conv_id", "turn"]
    table = written(grammars.productions(turns, "text", own), "productions")
    side = lambda name: table.select(*own, F.col("prod_id").alias(f"{name}_id"), F.col("height").alias(f"{name}_height"), F.col("len").alias(f"{name}_len"))
    both = table.join(side("left"), [*own, "left_id"], "left").join(side("right"), [*own, "right_id"], "left")
    pair = (F.abs(F.col("left_height") - F.col("right_height")) <= 1) & (F.col("height") == 1 + F.greatest("left_height", "right_height")) & (F.col("len") == F.col("left_len") + F.col("right_len"))
    right = F.when(F.col("kind") == "N", F.coalesce(pair, F.lit(False))).otherwise((F.col("height") == 0) & (F.col("len") == 1))
    held = both.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.max("height").alias("h"), F.bool_and(right).alias("balanced"))
    measured = grammars.compression(turns.withColumn("given", F.col("text").isNotNull()), "text", [*own, "given"])
    found = measured.join(held, own, "left").fillna(0, ["n", "h", "ratio"])
    agrees = (F.col("n") == F.col("n_productions")) & (F.col("h") == F.col("height")) & (F.abs(F.col("ratio") * F.col("derived_len") - F.col("n")) < 1e-6)
    balanced, length = F.coalesce("balanced", F.col("n_productions") == 0), F.when(F.col("given"), F.col("derived_len"))
    return found.select(*own, length.alias("derived_len"), balanced.alias("balanced"), agrees.alias("agrees"), (F.col("n_factors") <= F.col("derived_len")).alias("factors"))


def block_partition(spark, sf_dir):
    """Turns put together again from their blocks, which equal contents share;
    how many key blocks don't have x to 2x - 1 symbols, or others 2x or more."""
    turns, own = _turns(spark, sf_dir), ["conv_id", "turn"]
    cut = written(grammars.partition(turns, "text", own), "blocks")  # read twice, so that no text is compressed twice
    contents = cut.select("block_id", "content").distinct()
    joined = cut.drop("content").join(contents, "block_id")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "content")))
    key, size, x = F.col("kind") == "key", F.col("len"), grammars.block_size("derived_len", "n_productions")
    odd = F.when(key, (size < x) | (size >= 2 * x)).otherwise(size >= 2 * x)
    known = F.col("kind").isin("key", "left", "right")
    return joined.groupBy(*own).agg(F.array_join(F.transform(ordered, lambda v: v["content"]), "").alias("text"), F.sum("len").alias("len"), F.sum(odd.cast("long")).alias("odd_sizes"), F.bool_and(known).alias("known_kinds"))


def block_sizes(spark, sf_dir):
    """Block sizes of both routes, a part's key and size standing for symbols and productions."""
    part = table(spark, sf_dir, "part")
    size = lambda direct: grammars.block_size("p_partkey", "p_size", 0.4, 2.0, direct)
    return part.select("p_partkey", size(False).alias("x"), size(True).alias("x_direct"))


def dot_folded(spark, sf_dir):
    """Nodes and edges of the folded graph: a node for each different part of the halved text, two edges for each that is a pair."""
    dot = grammars.dot("p_name", builder="halved")
    count = lambda pattern: F.regexp_count(dot, F.lit(pattern)).cast("long")
    return _names(spark, sf_dir).select("p_name", count(r"\[label=").alias("nodes"), count(" -> ").alias("edges"), count('label="[^X"]').alias("letters"))


def dot_unfolded(spark, sf_dir):
    """Edges of the unfolded tree: two for each inner node, so twice the length less two."""
    lines = F.regexp_count(grammars.dot("p_name", folded=False), F.lit(" -- ")).cast("long")
    return _names(spark, sf_dir).select("p_name", lines.alias("edges"))


QUERIES = {f.__name__: f for f in (lz_factors, lz_factors_automaton, lz_benchmark, lz_fibonacci, slp_round_trip, slp_derive, slp_balanced, slp_halved, slp_blow_up, compression_ratio, block_partition, block_sizes, dot_folded, dot_unfolded)}

#: LZ factors of texts (k, t) by recursion: the longest extension that occurs in front, else one character.
LZ = """WITH RECURSIVE texts AS ({texts}), f AS (
  SELECT k, t, 0::BIGINT AS i, -1::BIGINT AS seq, 0::BIGINT AS b, 0::BIGINT AS n FROM texts UNION ALL
  SELECT k, t, i + greatest(m, 1), seq + 1, CASE WHEN m = 0 THEN i ELSE strpos(substr(t, 1, i), substr(t, i + 1, m)) - 1 END, greatest(m, 1) FROM (
    SELECT *, coalesce(list_max(list_filter(range(1, length(t) - i + 1), lambda l: contains(substr(t, 1, i), substr(t, i + 1, l)))), 0) AS m FROM f WHERE i < length(t)))"""
TEXTS = "SELECT p_name AS t FROM part UNION SELECT text FROM benchmark"
FACTORS = LZ.format(texts=f"SELECT t AS k, t FROM ({TEXTS})") + ' SELECT k AS text, seq, b AS "begin", b + n - 1 AS "end" FROM f WHERE seq >= 0'
#: The different parts of texts (k, t) that are halved again and again, the first half being the longer one.
HALVES = """WITH RECURSIVE parts AS (SELECT DISTINCT {k}, {t} AS part FROM {source} WHERE length({t}) > 0 UNION
  SELECT {k}, unnest([substr(part, 1, (length(part) + 1) // 2), substr(part, (length(part) + 1) // 2 + 1)]) FROM parts WHERE length(part) > 1)"""

ORACLES = {
    "lz_factors": FACTORS,
    "lz_factors_automaton": FACTORS,
    "lz_benchmark": LZ.format(texts="SELECT item_id AS k, text AS t FROM benchmark") + " SELECT k AS item_id, max(seq) + 1 AS n_factors, true AS agree FROM f GROUP BY k",
    "lz_fibonacci": FIBONACCI.format(to=16) + " SELECT p_partkey, n, n AS n_factors, length(text) AS derived_len, 2 * length(text) AS blown_len FROM part JOIN f ON n = 1 + p_partkey % 16",
    "slp_round_trip": "SELECT conv_id, turn, text AS balanced, text AS halved, text AS compressed FROM conversations",
    "slp_derive": f"SELECT t AS whole, t AS text FROM ({TEXTS})",
    "slp_balanced": "SELECT conv_id, turn, 2 * length(text) - 1 AS n_productions, length(text) AS derived_len FROM conversations",
    "slp_halved": HALVES.format(k="conv_id, turn", t="text", source="conversations") + " SELECT conv_id, turn, count(*) AS n_productions, ceil(log2(max(length(part))))::BIGINT AS height, round(count(*) / max(length(part)), 9) AS ratio FROM parts GROUP BY ALL",
    "compression_ratio": "SELECT conv_id, turn, length(text) AS derived_len, true AS balanced, true AS agrees, true AS factors FROM conversations",
    "slp_blow_up": "SELECT conv_id, turn, len(list_distinct(string_split(text, ''))) + 1 AS added, 2 * length(text) AS blown_len FROM conversations",
    "block_partition": "SELECT conv_id, turn, text, length(text) AS len, 0::BIGINT AS odd_sizes, true AS known_kinds FROM conversations",
    "block_sizes": """WITH f AS (SELECT p_partkey, greatest(2.0::DOUBLE, 2.0::DOUBLE * p_partkey / greatest(1, p_size)) AS f FROM part),
      x AS (SELECT p_partkey, least(floor(0.4::DOUBLE * greatest(f / sqrt(log2(f)), least(5, p_partkey)::DOUBLE))::BIGINT, p_partkey::BIGINT) AS x FROM f)
      SELECT p_partkey, greatest(x, 1) AS x, greatest(x, 0) AS x_direct FROM x""",
    "dot_folded": HALVES.format(k="p_name", t="p_name", source="part") + " SELECT p_name, count(*) AS nodes, 2 * count(*) FILTER (length(part) > 1) AS edges, count(*) FILTER (length(part) = 1) AS letters FROM parts GROUP BY p_name",
    "dot_unfolded": "SELECT DISTINCT p_name, 2 * length(p_name) - 2 AS edges FROM part",
}
