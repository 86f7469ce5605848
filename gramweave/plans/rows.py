"""Queries on operators that keep permutations, grids and grammars as rows over many tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gramweave.operators import monge, shared, tables, tropical, wavefront
from gramweave.operators.places import running
from gramweave.plans.algebra import ORACLES as ALGEBRA
from gramweave.plans.algebra import _pairs, _prefix_lengths, _zero
from gramweave.plans.distances import ORACLES as DISTANCES
from gramweave.plans.distances import part_pairs, table
from gramweave.plans.grammars import HALVES

#: Symbols of a production that ranges are read from without halving it.
EXTRACTED = 64


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("key"), "o_orderkey", "o_orderdate", "o_totalprice")


def _permutations(rows, by: list[str]):
    """Orders by key against their places by date, and against those by price. Places by key stand for the keys from there on."""
    rows = running(rows, by, ["o_orderkey"], into="k").drop("o_orderkey")
    rows = running(rows, by, ["o_totalprice", "k"], into="t").drop("o_totalprice")
    rows = running(rows, by, ["o_orderdate", "k"], into="d").drop("o_orderdate")
    return rows.select(*by, F.col("k").alias("r"), F.col("d").alias("c")), rows.select(*by, F.col("k").alias("r"), F.col("t").alias("c"))


def unit_monge_groups(spark, sf_dir):
    """The product of two orders of each customer's orders, many customers in a task."""
    p, q = _permutations(_orders(spark, sf_dir), ["key"])
    return monge.product(p, q, "key", block=8, strip=8)


def unit_monge_orders(spark, sf_dir):
    """The product of two orders of all orders: how many of its points lie from a row on and before a column, at eighths of both."""
    p, q = _permutations(_orders(spark, sf_dir).drop("key"), [])
    found = monge.product(p, q, block=4096, strip=1024)
    n = found.agg(F.count(F.lit(1)).alias("n"))
    eighth = lambda name: F.explode(F.sequence(F.lit(0), F.lit(8))).alias(name)
    asked = n.select("n", eighth("x")).select("n", "x", eighth("y")).select(F.floor(F.col("n") * F.col("x") / 8).alias("i"), F.floor(F.col("n") * F.col("y") / 8).alias("j"))
    return tropical.dominance(found, asked).withColumnRenamed("count", "v")


def dominance_counts(spark, sf_dir):
    """Orders of customers from a part's key on whose total is less than a hundred times its price; the density of H there."""
    points = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("r"), F.floor("o_totalprice").alias("c"))
    asked = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("long").alias("i"), F.floor(100 * F.col("p_retailprice")).cast("long").alias("j"))
    return tropical.dominance(points, asked).select("p_partkey", F.col("count").cast("long").alias("orders"), (F.col("j") - F.col("i") - F.col("count")).cast("long").alias("h"))


def wavefront_turns(spark, sf_dir):
    """Byte distance of each turn to the next one of its conversation, in blocks that advance by anti-diagonals."""
    turns = table(spark, sf_dir, "conversations")
    pairs = turns.select("conv_id", "turn", F.col("text").alias("a")).join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b")), ["conv_id", "turn"])
    return wavefront.wavefront(pairs, unit="bytes", size=256).select("conv_id", "turn", "distance")


def wavefront_common(spark, sf_dir):
    """Common subsequences of names and types of parts, in blocks of four symbols."""
    return wavefront.wavefront(part_pairs(spark, sf_dir).select("a", "b"), kind="subsequence", into="lcs", size=4)


def shared_productions(spark, sf_dir):
    """Different productions of all turns together, by the length of what they derive."""
    return shared.productions(table(spark, sf_dir, "conversations")).groupBy("size").agg(F.count(F.lit(1)).alias("productions"))


def range_extraction(spark, sf_dir):
    """The middle third of each turn, read from the shared productions alone."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    grammar = shared.productions(turns, leaf=EXTRACTED)
    length = F.char_length("text")
    asked = turns.select(F.struct("conv_id", "turn").alias("id"), F.when(length > 0, shared.node_of("text")).alias("node"), F.floor(length / 3).alias("begin"), F.ceil(2 * length / 3).alias("end"))
    return shared.extract(asked, grammar).select("id.conv_id", "id.turn", "text")


def repository_levels(spark, sf_dir):
    """Common subsequences with prefixes from a repository that all pairs share, of leaves so small that all levels are merged."""
    pairs = _pairs(spark, sf_dir)
    grammar = shared.productions(pairs.select(F.col("a").alias("text")).unionByName(pairs.select(F.col("b").alias("text"))))
    named = pairs.where("char_length(a) > 0 AND char_length(b) > 0").select("a", "b", shared.node_of("a").alias("p"), shared.node_of("b").alias("q"))
    found = named.join(shared.repository(named, grammar, leaf=16), ["p", "q"])
    return _prefix_lengths(found.withColumn("outputs", tables.apply("table", _zero("a", "b"))))


QUERIES = {f.__name__: f for f in (unit_monge_groups, unit_monge_orders, dominance_counts, wavefront_turns, wavefront_common, shared_productions, range_extraction, repository_levels)}

#: Orders as permutations, of each customer or of all: places by key against places by date (p) and by price (q).
PLACED = """WITH o AS (SELECT {key} AS key, row_number() OVER ({by} ORDER BY o_orderkey) - 1 AS r, row_number() OVER ({by} ORDER BY o_orderdate, o_orderkey) - 1 AS d,
  row_number() OVER ({by} ORDER BY o_totalprice, o_orderkey) - 1 AS t FROM orders)"""
BY_CUSTOMER = PLACED.format(key="o_custkey::BIGINT", by="PARTITION BY o_custkey")
SIGMA = "SELECT g.key, i, j, count(p.r) AS v FROM spots g LEFT JOIN (SELECT key, r, {c} AS c FROM o) p ON p.key = g.key AND p.r >= i AND p.c < j GROUP BY ALL"

ORACLES = {
    "unit_monge_groups": f"""{BY_CUSTOMER}, n AS (SELECT key, count(*) AS n FROM o GROUP BY key), line AS (SELECT key, unnest(range(0, n + 1)) AS i FROM n),
      spots AS (SELECT a.key, a.i, b.i AS j FROM line a JOIN line b USING (key)), sp AS ({SIGMA.format(c="d")}), sq AS ({SIGMA.format(c="t")}),
      m AS (SELECT sp.key, sp.i, sq.j, min(sp.v + sq.v) AS v FROM sp JOIN sq ON sp.key = sq.key AND sp.j = sq.i GROUP BY ALL),
      d AS (SELECT key, i, j, lead(v) OVER (PARTITION BY key, i ORDER BY j) - v AS d FROM m),
      w AS (SELECT key, i, j, d - lead(d) OVER (PARTITION BY key, j ORDER BY i) AS w FROM d) SELECT key, i AS r, j AS c FROM w WHERE w = 1""",
    "unit_monge_orders": f"""{PLACED.format(key="0", by="")}, n AS (SELECT count(*) AS n FROM o), spots AS (SELECT n * x // 8 AS spot FROM n, (SELECT unnest(range(0, 9)) AS x)),
      p AS (SELECT spot AS i, d + 1 AS k, sum((r >= spot)::INT) OVER (PARTITION BY spot ORDER BY d) AS v FROM o, spots UNION ALL SELECT spot, 0, 0 FROM spots),
      q AS (SELECT spot AS j, r AS k, sum((t < spot)::INT) OVER (PARTITION BY spot ORDER BY r DESC) AS v FROM o, spots UNION ALL SELECT spot, (SELECT n FROM n), 0 FROM spots)
      SELECT p.i, q.j, min(p.v + q.v)::BIGINT AS v FROM p JOIN q USING (k) GROUP BY ALL""",
    "dominance_counts": """WITH c AS (SELECT p_partkey, count(o_orderkey) AS orders FROM part LEFT JOIN orders ON o_custkey >= p_partkey AND floor(o_totalprice) < floor(100 * p_retailprice) GROUP BY p_partkey)
      SELECT p_partkey, orders, floor(100 * p_retailprice)::BIGINT - p_partkey - orders AS h FROM c JOIN part USING (p_partkey)""",
    "wavefront_turns": "SELECT a.conv_id, a.turn, levenshtein(a.text, b.text)::BIGINT AS distance FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn",
    "wavefront_common": DISTANCES["lcs_pairs"],
    "shared_productions": HALVES.format(k="0 AS k", t="text", source="conversations").replace("SELECT 0 AS k, unnest", "SELECT k, unnest") + " SELECT length(part) AS size, count(*) AS productions FROM parts GROUP BY size",
    "range_extraction": "SELECT conv_id, turn, substr(text, length(text) // 3 + 1, ((2 * length(text) + 2) // 3 - length(text) // 3)) AS text FROM conversations",
    "repository_levels": ALGEBRA["table_apply"],
}
