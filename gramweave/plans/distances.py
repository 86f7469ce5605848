"""Queries on string distances, sources of strings, and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramweave.functions import strings
from gramweave.operators import components, distance
from gramweave.sources import fasta, generate


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types of parts, whose letters differ in case: (a, b) with how many parts have them."""
    return table(spark, sf_dir, "part").groupBy(F.upper("p_name").alias("a"), F.col("p_type").alias("b")).agg(F.count(F.lit(1)).alias("parts"))


def lev_part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all pairs of parts of one brand, from the pairs of its distinct names and their counts."""
    names = table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.count(F.lit(1)).alias("n"))
    a, b = names.select("p_brand", F.col("p_name").alias("a"), F.col("n").alias("na")), names.select("p_brand", F.col("p_name").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, "p_brand").where("a <= b")
    d = strings.levenshtein(F.col("a"), F.col("b"))
    weight = F.when(F.col("a") < F.col("b"), F.col("na") * F.col("nb")).otherwise(F.expr("na * (na - 1) div 2"))
    counted = pairs.withColumn("d", d).withColumn("w", weight).where("w > 0")
    return counted.groupBy("p_brand").agg(F.sum("w").alias("pairs"), F.sum(F.col("w") * F.col("d")).alias("total_distance"), F.max("d").alias("max_distance"))


def lev_threshold(spark, sf_dir):
    return distance.within(part_pairs(spark, sf_dir), 8)


def lev_rows(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("a"), F.col("p_type").alias("b"))
    return distance.distance(part).select("p_partkey", "distance")


def lev_topk_nearest(spark, sf_dir):
    found = distance.nearest(part_pairs(spark, sf_dir).select("a", "b"), ["b"], 3, ties=["a"])
    return found.select("b", "a", "distance", "rank")


def lev_near_names(spark, sf_dir):
    """Distinct names of one type that differ by four edits at most, by a join on type and length."""
    names = table(spark, sf_dir, "part").select("p_type", "p_name").distinct()
    return distance.within_blocks(names, F.col("p_type"), "p_name", "p_name", 4).distinct()


def lev_bytes_turns(spark, sf_dir):
    """Byte distance of each turn to the next one of its conversation."""
    turns = table(spark, sf_dir, "conversations")
    pairs = turns.select("conv_id", "turn", F.col("text").alias("a")).join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b")), ["conv_id", "turn"])
    pairs = pairs.repartition(spark.sparkContext.defaultParallelism, "conv_id", "turn")
    return distance.distance(pairs, engine="long", unit="bytes").select("conv_id", "turn", "distance")


def _wild(spark, sf_dir):
    return part_pairs(spark, sf_dir).select(F.translate("a", "AEIOU", "*****").alias("a"), "b").distinct()


def lev_wildcard(spark, sf_dir):
    return distance.distance(_wild(spark, sf_dir), wildcard=True)


def lcs_wildcard(spark, sf_dir):
    return distance.distance(_wild(spark, sf_dir), engine="lcs", into="lcs")


def lcs_pairs(spark, sf_dir):
    return distance.distance(part_pairs(spark, sf_dir).select("a", "b"), engine="lcs", into="lcs")


def lcs_native_pairs(spark, sf_dir):
    pairs = part_pairs(spark, sf_dir).select("a", "b")
    return pairs.withColumn("lcs", strings.lcs_native(F.col("a"), F.col("b")))


def indel_pairs(spark, sf_dir):
    return distance.distance(part_pairs(spark, sf_dir).select("a", "b"), engine="indel")


def blow_up_pairs(spark, sf_dir):
    return distance.distance(part_pairs(spark, sf_dir).select("a", "b"), engine="blow_up")


def compressed_pairs(spark, sf_dir):
    return distance.distance(part_pairs(spark, sf_dir).select("a", "b"), engine="grammar")


def compressed_pairs_direct(spark, sf_dir):
    return distance.distance(part_pairs(spark, sf_dir).select("a", "b"), engine="grammar_direct")


def compressed_fibonacci(spark, sf_dir):
    """For each supplier a Fibonacci string of its letters and the next one, over compressed blocks; of equal ones, once."""
    key = F.col("s_suppkey")
    n, letters = 1 + key % 15, [F.char(97 + key % 13), F.char(110 + F.floor(key / 13) % 13)]
    pairs = table(spark, sf_dir, "supplier").select("s_suppkey", n.cast("long").alias("n"), generate.fibonacci_text(n, *letters).alias("a"), generate.fibonacci_text(n + 1, *letters).alias("b"))
    return distance.distance(pairs, engine="grammar").select("s_suppkey", "n", "distance")


def order_pairs(spark, sf_dir):
    """Priorities of orders and segments of their customers: distances weighted by how many orders have them."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counted = joined.groupBy(F.col("o_orderpriority").alias("a"), F.col("c_mktsegment").alias("b")).agg(F.count(F.lit(1)).alias("orders"))
    return distance.distance(counted)


def dp_grid(spark, sf_dir):
    pairs = part_pairs(spark, sf_dir).select("a", "b")
    return distance.grid_cells(pairs, ["a", "b"])


def substitution_cost(spark, sf_dir):
    """The cost of a symbol against another, a wildcard on either side being free."""
    chars = _wild(spark, sf_dir).select(F.explode(F.split("a", "")).alias("x"), "b").distinct().select("x", F.explode(F.split("b", "")).alias("y")).distinct()
    return chars.withColumn("cost", F.when((F.col("x") == F.col("y")) | (F.col("x") == "*") | (F.col("y") == "*"), 0).otherwise(1).cast("long"))


def fibonacci_strings(spark, sf_dir):
    """For each part the Fibonacci string of a number from 2 on."""
    n = 2 + F.col("p_partkey") % 14
    found = table(spark, sf_dir, "part").select("p_partkey", n.cast("long").alias("n"), generate.fibonacci_text(n).alias("text"))
    return found.withColumn("len", F.char_length("text").cast("long"))


def periodic_strings(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", generate.periodic(F.col("p_size")).alias("text"))


def random_prefixes(spark, sf_dir):
    """Of one seed, is the text of p_size characters a prefix of the next longer one, and of the right length?"""
    part = table(spark, sf_dir, "part")
    a, b = generate.random_text(F.col("p_size")), generate.random_text(F.col("p_size") + 1)
    return part.select("p_partkey", F.startswith(b, a).alias("is_prefix"), F.char_length(a).cast("long").alias("len"), F.regexp_count(a, F.lit("[^acgt]")).cast("long").alias("others"))


def random_stream(spark, sf_dir):
    """For each customer a text of one stream: its length, characters of no alphabet, and whether the next one goes on with it (it starts anew)."""
    rows = generate.stream_texts(table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 200 + 1).alias("len")), "len", "c_custkey")
    after = rows.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("text").alias("after"))
    goes_on = F.coalesce(F.startswith("after", F.col("text")), F.lit(False)) & (F.col("len") > 12)
    return rows.join(after, "c_custkey", "left").select("c_custkey", F.char_length("text").cast("long").alias("found"), F.regexp_count("text", F.lit("[^acgt]")).cast("long").alias("others"), goes_on.alias("goes_on"), F.when(F.col("len") > 80, F.size(F.array_distinct(F.split("text", "")))).cast("long").alias("letters"))


def prefix_growth(spark, sf_dir):
    return generate.prefixes(table(spark, sf_dir, "benchmark"), "text", 1000, ["item_id"])


def fasta_records(spark, sf_dir):
    """Conversations as sequence files: a user's turn is a header, any other one a line."""
    turns = table(spark, sf_dir, "conversations")
    line = F.when(F.col("role") == "user", F.concat(F.lit(">"), "text")).otherwise(F.col("text"))
    lines = turns.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("n"), line.alias("value"))
    return fasta.read_lines(spark, lines)


def supplier_components(spark, sf_dir):
    """Suppliers, nations and regions as one graph: the least node of each one's component. A node's number is thrice its
    key and its kind, so that no two kinds meet whatever the keys are."""
    node = lambda key, kind: (3 * F.col(key).cast("long") + kind)
    nation = table(spark, sf_dir, "nation").select(node("n_nationkey", 1).alias("a"), node("n_regionkey", 2).alias("b"))
    edges = table(spark, sf_dir, "supplier").select(node("s_suppkey", 0).alias("a"), node("s_nationkey", 1).alias("b")).unionByName(nation)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return components.components(nodes, edges)


def part_intervals(spark, sf_dir):
    """Parts of a brand in order; a part of size above 25 ends no interval."""
    part = table(spark, sf_dir, "part")
    points = part.select("p_brand", F.col("p_partkey").alias("x"))
    return components.interval_find(points, part.where("p_size > 25").select(F.col("p_partkey").alias("x")), by="p_brand")


def interval_words(spark, sf_dir):
    """The surviving ends of the parts' intervals, 64 to a word."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("x"), "p_size")
    return components.interval_words(part.select("x"), part.where("p_size > 25").select("x"))


def bit_places(spark, sf_dir):
    word, bit = components.bit_place("p_partkey")
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", word.alias("word"), bit.alias("bit"), F.ceil(F.col("p_partkey") / 7).cast("long").alias("ceil_div"), F.when(F.col("p_partkey") > 0, F.length(F.conv(F.col("p_partkey").cast("string"), 10, 2))).otherwise(-1).cast("long").alias("msb"))


#: The rows of the subsequence table for pairs (a, b), as lists, by recursion over a's characters.
LCS_ROWS = """
  rows AS (
    SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0::BIGINT) AS r FROM pairs
    UNION ALL
    SELECT a, b, i + 1, list_reduce(
      list_transform(range(1, length(b) + 1), lambda j: [greatest(r[j + 1], r[j] + CASE WHEN a[i + 1] = b[j] OR (wild AND (a[i + 1] = '*' OR b[j] = '*')) THEN 1 ELSE 0 END)]),
      lambda acc, x: list_append(acc, greatest(acc[len(acc)], x[1])), [0::BIGINT])
    FROM rows, mode WHERE i < length(a))
"""
PAIRS = "SELECT DISTINCT upper(p_name) AS a, p_type AS b FROM part"
WILD = "SELECT DISTINCT translate(upper(p_name), 'AEIOU', '*****') AS a, p_type AS b FROM part"


def _lcs(pairs: str, wild: bool, select: str) -> str:
    return f"WITH RECURSIVE mode AS (SELECT {wild} AS wild), pairs AS ({pairs}), {LCS_ROWS} {select}"


LAST = "FROM rows WHERE i = length(a)"
FIBONACCI = "WITH RECURSIVE f AS (SELECT 0::BIGINT AS n, '' AS text, 'a' AS following UNION ALL SELECT n + 1, following, CASE WHEN n = 0 THEN 'ab' ELSE following || text END FROM f WHERE n < {to})"
LENGTHS = "WITH RECURSIVE l AS (SELECT 1::BIGINT AS len UNION ALL SELECT greatest(ceil(1.7 * len)::BIGINT, len + 1) FROM l WHERE greatest(ceil(1.7 * len)::BIGINT, len + 1) < {most})"

QUERIES = {f.__name__: f for f in (
    lev_part_pairs, lev_threshold, lev_rows, lev_topk_nearest, lev_near_names, lev_bytes_turns, lev_wildcard, lcs_wildcard, lcs_pairs, lcs_native_pairs, indel_pairs, blow_up_pairs, compressed_pairs,
    compressed_pairs_direct, compressed_fibonacci, order_pairs, dp_grid, substitution_cost, fibonacci_strings, periodic_strings, random_prefixes, random_stream, prefix_growth, fasta_records,
    supplier_components, part_intervals, interval_words, bit_places,
)}

ORACLES = {
    "lev_part_pairs": """SELECT a.p_brand, count(*) AS pairs, sum(levenshtein(a.p_name, b.p_name))::BIGINT AS total_distance, max(levenshtein(a.p_name, b.p_name))::BIGINT AS max_distance
      FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey GROUP BY a.p_brand""",
    "lev_threshold": "SELECT a, b, parts, levenshtein(a, b)::BIGINT AS distance FROM (SELECT upper(p_name) AS a, p_type AS b, count(*) AS parts FROM part GROUP BY ALL) WHERE levenshtein(a, b) <= 8",
    "lev_rows": "SELECT p_partkey, levenshtein(upper(p_name), p_type)::BIGINT AS distance FROM part",
    "lev_topk_nearest": f"SELECT b, a, levenshtein(a, b)::BIGINT AS distance, row_number() OVER (PARTITION BY b ORDER BY levenshtein(a, b), a) AS rank FROM ({PAIRS}) QUALIFY rank <= 3",
    "lev_near_names": "SELECT DISTINCT a.p_name AS id_a, b.p_name AS id_b, levenshtein(a.p_name, b.p_name)::BIGINT AS distance FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) <= 4",
    "lev_bytes_turns": "SELECT a.conv_id, a.turn, levenshtein(a.text, b.text)::BIGINT AS distance FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn",
    "lev_wildcard": f"""WITH RECURSIVE pairs AS ({WILD}), rows AS (
      SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: x::BIGINT) AS r FROM pairs UNION ALL
      SELECT a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [least(r[j + 1] + 1, r[j] + CASE WHEN a[i + 1] = b[j] OR a[i + 1] = '*' OR b[j] = '*' THEN 0 ELSE 1 END)]),
        lambda acc, x: list_append(acc, least(acc[len(acc)] + 1, x[1])), [(i + 1)::BIGINT]) FROM rows WHERE i < length(a))
      SELECT a, b, r[len(r)] AS distance {LAST}""",
    "lcs_wildcard": _lcs(WILD, True, f"SELECT a, b, r[len(r)] AS lcs {LAST}"),
    "lcs_pairs": _lcs(PAIRS, True, f"SELECT a, b, r[len(r)] AS lcs {LAST}"),
    "lcs_native_pairs": _lcs(PAIRS, False, f"SELECT a, b, r[len(r)] AS lcs {LAST}"),
    "indel_pairs": _lcs(PAIRS, False, f"SELECT a, b, length(a) + length(b) - 2 * r[len(r)] AS distance {LAST}"),
    "blow_up_pairs": f"SELECT a, b, levenshtein(a, b)::BIGINT AS distance FROM ({PAIRS})",
    "compressed_pairs": f"SELECT a, b, levenshtein(a, b)::BIGINT AS distance FROM ({PAIRS})",
    "compressed_pairs_direct": f"SELECT a, b, levenshtein(a, b)::BIGINT AS distance FROM ({PAIRS})",
    "compressed_fibonacci": FIBONACCI.format(to=16) + " SELECT s_suppkey, n, levenshtein(text, following)::BIGINT AS distance FROM supplier JOIN f ON n = 1 + s_suppkey % 15",
    "order_pairs": "SELECT o_orderpriority AS a, c_mktsegment AS b, count(*) AS orders, levenshtein(a, b)::BIGINT AS distance FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "dp_grid": _lcs(PAIRS, True, "SELECT a, b, i::BIGINT AS i, unnest(range(0, len(r))) AS j, unnest(r) AS v FROM rows"),
    "substitution_cost": f"""WITH w AS ({WILD}), x AS (SELECT DISTINCT unnest(string_split(a, '')) AS x, b FROM w), y AS (SELECT DISTINCT x, unnest(string_split(b, '')) AS y FROM x)
      SELECT x, y, CASE WHEN x = y OR x = '*' OR y = '*' THEN 0 ELSE 1 END::BIGINT AS cost FROM y""",
    "fibonacci_strings": FIBONACCI.format(to=16) + " SELECT p_partkey, n, text, length(text) AS len FROM part JOIN f ON n = 2 + p_partkey % 14",
    "periodic_strings": "SELECT p_partkey, substr(repeat('acgt', 1 + p_size), 1, p_size) AS text FROM part",
    "random_prefixes": "SELECT p_partkey, true AS is_prefix, p_size::BIGINT AS len, 0::BIGINT AS others FROM part",
    "random_stream": "SELECT c_custkey, c_custkey % 200 + 1 AS found, 0::BIGINT AS others, false AS goes_on, CASE WHEN c_custkey % 200 + 1 > 80 THEN 4 END::BIGINT AS letters FROM customer",
    "prefix_growth": LENGTHS.format(most=1000) + " SELECT item_id, len, substr(text, 1, len) AS prefix FROM benchmark, l WHERE len < length(text)",
    "fasta_records": """WITH lines AS (SELECT conv_id::VARCHAR AS file, turn AS n, CASE WHEN role = 'user' THEN '>' || text ELSE text END AS value FROM conversations),
      marked AS (SELECT *, sum(CASE WHEN starts_with(value, '>') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY n)::BIGINT AS record FROM lines WHERE NOT starts_with(value, ';')),
      rows AS (SELECT file, record, coalesce(max(CASE WHEN starts_with(value, '>') THEN substr(value, 2) END), '') AS name, coalesce(string_agg(replace(value, ' ', ''), '' ORDER BY n) FILTER (NOT starts_with(value, '>')), '') AS seq FROM marked GROUP BY file, record)
      SELECT file, record, name, seq FROM rows QUALIFY seq <> '' OR record = max(record) OVER (PARTITION BY file) AND record > 0""",
    "supplier_components": """WITH RECURSIVE e AS (SELECT 3 * s_suppkey AS a, 3 * s_nationkey + 1 AS b FROM supplier UNION ALL SELECT 3 * n_nationkey + 1, 3 * n_regionkey + 2 FROM nation),
      s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS seen FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.seen = s.a)
      SELECT node::BIGINT AS node, min(seen)::BIGINT AS root FROM r GROUP BY node""",
    "part_intervals": "SELECT p_brand, p_partkey AS x, min(CASE WHEN p_size <= 25 THEN p_partkey END) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last FROM part",
    "interval_words": "SELECT p_partkey // 64 AS word, string_agg(CASE WHEN p_size > 25 THEN '0' ELSE '1' END, '' ORDER BY p_partkey DESC) AS bits FROM part GROUP BY word",
    "bit_places": "SELECT p_partkey, p_partkey // 64 AS word, p_partkey % 64 AS bit, ceil(p_partkey / 7)::BIGINT AS ceil_div, CASE WHEN p_partkey > 0 THEN length(bin(p_partkey)) ELSE -1 END::BIGINT AS msb FROM part",
}
