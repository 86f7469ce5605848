"""Queries on matrices, permutations and boundary-transfer tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gramweave.operators import tables, tropical
from gramweave.plans.distances import LAST, PAIRS, _lcs, part_pairs, table
from gramweave.sources.scratch import written


def _a(spark, sf_dir):
    """Line numbers by ship month: summed quantities."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("i"), F.month("l_shipdate").cast("long").alias("j"))
    return rows.agg(F.sum("l_quantity").cast("long").alias("v"))


def _b(spark, sf_dir):
    """Order months by days of the month: orders."""
    return table(spark, sf_dir, "orders").groupBy(F.month("o_orderdate").cast("long").alias("i"), F.dayofmonth("o_orderdate").cast("long").alias("j")).agg(F.count(F.lit(1)).alias("v"))


def _p(spark, sf_dir, order: str = "n_name"):
    """Nations as a permutation: keys against places in an order."""
    place = F.row_number().over(Window.orderBy(order, "n_nationkey")) - 1
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("r"), place.cast("long").alias("c"))


def _q(spark, sf_dir):
    return _p(spark, sf_dir, "n_regionkey")


def min_plus(spark, sf_dir):
    return tropical.min_plus(_a(spark, sf_dir), _b(spark, sf_dir))


def max_plus(spark, sf_dir):
    return tropical.max_plus(_a(spark, sf_dir), _b(spark, sf_dir))


def max_plus_part(spark, sf_dir):
    """The product of sub-matrices: half-open ranges."""
    return tropical.max_plus(tropical.submatrix(_a(spark, sf_dir), 2, 6, 1, 10), tropical.submatrix(_b(spark, sf_dir), 1, 10, 5, 20))


def vector_max_plus(spark, sf_dir):
    vector = table(spark, sf_dir, "orders").groupBy(F.month("o_orderdate").cast("long").alias("i")).agg(F.count(F.lit(1)).alias("v"))
    return tropical.vector_max_plus(vector, _b(spark, sf_dir))


def matrix_equal(spark, sf_dir):
    a, b = _a(spark, sf_dir), _b(spark, sf_dir)
    return tropical.equal(a, a).withColumnRenamed("equal", "same").crossJoin(tropical.equal(a, b).withColumnRenamed("equal", "other"))


def matrix_fill(spark, sf_dir):
    """For each supplier a matrix that its key fills."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return tropical.filled_each(table(spark, sf_dir, "supplier"), "s_suppkey", key % 4, 1 + nation % 5, key)


def distribution(spark, sf_dir):
    return tropical.permutation_distribution(_p(spark, sf_dir))


def density(spark, sf_dir):
    return tropical.density(tropical.permutation_distribution(_p(spark, sf_dir)))


def unfold_h(spark, sf_dir):
    return tropical.h_transform(tropical.permutation_distribution(_p(spark, sf_dir)), 10)


def h_inverse(spark, sf_dir):
    return tropical.h_transform(unfold_h(spark, sf_dir), 10)


def permutation_matrix(spark, sf_dir):
    return tropical.permutation_matrix(_p(spark, sf_dir))


def permutation_inverse(spark, sf_dir):
    return tropical.inverse(_p(spark, sf_dir))


def permutation_valid(spark, sf_dir):
    return tropical.is_permutation(_p(spark, sf_dir))


def permutation_swap(spark, sf_dir):
    return tropical.swap(_p(spark, sf_dir))


def permutation_sum(spark, sf_dir):
    return tropical.direct_sum(_p(spark, sf_dir), _q(spark, sf_dir))


def _array(p):
    return F.transform(F.array_sort(F.collect_list(F.struct("r", "c"))), lambda x: x["c"])


def unit_monge(spark, sf_dir):
    """The product by the fast kernel, over array columns."""
    p, q = (f(spark, sf_dir).agg(_array(None).alias(name)) for f, name in ((_p, "p"), (_q, "q")))
    found = p.crossJoin(q).select(F.posexplode(tables.product("p", "q")).alias("r", "c"))
    return found.select(F.col("r").cast("long").alias("r"), "c")


def unit_monge_definition(spark, sf_dir):
    return tropical.unit_monge_by_definition(_p(spark, sf_dir), _q(spark, sf_dir))


def _characters(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_orderstatus").alias("a"), F.col("l_linestatus").alias("b")).distinct()


def _joined(cells):
    return F.array_join(F.transform(F.flatten(cells), lambda v: F.coalesce(v.cast("string"), F.lit("far"))), ",")


def cell_tables(spark, sf_dir):
    """The tables of two single characters, of all three kinds."""
    a, b = F.col("a"), F.col("b")
    perm = F.array_join(F.transform(tables.cell(a, b)["perm"], lambda v: v.cast("string")), ",")
    return _characters(spark, sf_dir).select("a", "b", perm.alias("perm"), _joined(tables.cell_h(a, b)).alias("h"), _joined(tables.cell_distance(a, b)).alias("distance"))


def _pairs(spark, sf_dir):
    return part_pairs(spark, sf_dir).select("a", "b")


def _prefix_lengths(outputs):
    """Outputs along the bottom: the common subsequence of a and each prefix of b."""
    return outputs.select("a", "b", F.posexplode("outputs").alias("j", "lcs")).where(F.col("j") <= F.char_length("b")).select("a", "b", F.col("j").cast("long").alias("j"), "lcs")


def _zero(a, b):
    return F.array_repeat(F.lit(0).cast("long"), (F.char_length(a) + F.char_length(b) + 1).cast("int"))


def table_apply(spark, sf_dir):
    built = _pairs(spark, sf_dir).withColumn("table", tables.build("a", "b"))
    return _prefix_lengths(built.withColumn("outputs", tables.apply("table", _zero("a", "b"))))


def table_stack(spark, sf_dir):
    """Tables of the halves of a, stacked."""
    cut = F.floor(F.char_length("a") / 2).cast("int")
    halves = _pairs(spark, sf_dir).where("char_length(a) > 1").withColumn("top", tables.build(F.substring("a", F.lit(1), cut), F.col("b"))).withColumn("bottom", tables.build(F.expr("substring(a, char_length(a) div 2 + 1)"), F.col("b")))
    return _prefix_lengths(halves.withColumn("outputs", tables.apply(tables.stack("top", "bottom"), _zero("a", "b"))))


def table_beside(spark, sf_dir):
    """Tables of the halves of b, side by side."""
    cut = F.floor(F.char_length("b") / 2).cast("int")
    halves = _pairs(spark, sf_dir).where("char_length(b) > 1").withColumn("left", tables.build(F.col("a"), F.substring("b", F.lit(1), cut))).withColumn("right", tables.build(F.col("a"), F.expr("substring(b, char_length(b) div 2 + 1)")))
    return _prefix_lengths(halves.withColumn("outputs", tables.apply(tables.beside("left", "right"), _zero("a", "b"))))


def table_reduce(spark, sf_dir):
    """Tables of single characters of a, stacked in rounds."""
    chars = _pairs(spark, sf_dir).select("a", "b", F.posexplode(F.split("a", "")).alias("k", "c")).withColumn("table", tables.build("c", "b"))
    return _prefix_lengths(tables.reduce_stack(chars, ["a", "b"], "k").withColumn("outputs", tables.apply("table", _zero("a", "b"))))


def _dense_parts(spark, sf_dir, kind: str, vertical: bool):
    """Dense tables of the halves of a (or b), merged and applied along the border of an empty table."""
    make = tables.build_distance if kind == "distance" else tables.build_h
    cut, other = ("a", "b") if vertical else ("b", "a")
    half = F.floor(F.char_length(cut) / 2).cast("int")
    parts = _pairs(spark, sf_dir).where(F.char_length(cut) > 1).withColumn("x", F.substring(cut, F.lit(1), half)).withColumn("y", F.expr(f"substring({cut}, char_length({cut}) div 2 + 1)"))
    tabled = parts.withColumn("s", make("x", "b") if vertical else make("a", "x")).withColumn("t", make("y", "b") if vertical else make("a", "y"))
    merged = tabled.withColumn("table", tables.merge_dense("s", "t", F.char_length(other), kind, vertical))
    return _prefix_lengths(merged.withColumn("outputs", tables.apply_dense("table", _border(kind), F.char_length("a"), kind)))


def _border(kind: str):
    if kind == "h":
        return _zero("a", "b")
    m = F.char_length("a")
    return F.transform(F.sequence(F.lit(0), m + F.char_length("b")), lambda i: F.abs(m - i).cast("long"))


def dense_stack(spark, sf_dir):
    return _dense_parts(spark, sf_dir, "distance", True).withColumnRenamed("lcs", "distance")


def dense_beside(spark, sf_dir):
    return _dense_parts(spark, sf_dir, "distance", False).withColumnRenamed("lcs", "distance")


def h_stack(spark, sf_dir):
    return _dense_parts(spark, sf_dir, "h", True)


def h_beside(spark, sf_dir):
    return _dense_parts(spark, sf_dir, "h", False)


def block_repository(spark, sf_dir):
    """The repository: the table of each two blocks that some pair needs, once. Every table, applied to an empty border,
    gives the common subsequence of its blocks; the blocks of a pair have all of its symbols, blown up."""
    from gramweave.functions import strings
    from gramweave.operators import blocks

    cut = strings.kernel(blocks._cut(False, 1.0, 1.0), blocks.SEQUENCE)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = _pairs(spark, sf_dir).repartition(parts, "a", "b")  # few rows, each much work
    sequences = written(pairs.select("a", "b", cut("a").alias("a_seq"), cut("b").alias("b_seq")), "sequences")  # read twice
    rows = sequences.select("a", "b", F.explode("a_seq").alias("x"), "b_seq").select("a", "b", "x", F.explode("b_seq").alias("y"))
    rows = rows.select("a", "b", F.col("x.block").alias("a_block"), F.col("x.content").alias("u"), F.col("y.block").alias("b_block"), F.col("y.content").alias("v"))
    spelt = lambda c: F.array_join(F.transform(c, lambda k: F.when(k < 0, F.lit("$")).otherwise(F.char(k))), "")
    held = rows.join(blocks.repository(sequences, direct=False), ["a_block", "b_block"])
    m, n = F.size("u").cast("long"), F.size("v").cast("long")
    border = F.array_repeat(F.lit(0).cast("long"), (m + n + 1).cast("int"))
    found = tables.apply(F.struct(m.alias("rows"), n.alias("cols"), F.col("cells").alias("perm")), border)
    checked = held.withColumn("found", F.get(found, n.cast("int"))).withColumn("lcs", strings.lcs_native(spelt(F.col("u")), spelt(F.col("v"))))
    return checked.groupBy("a", "b").agg(F.bool_and(F.col("found") == F.col("lcs")).alias("agree"), F.sum(m * n).alias("cells"))


def table_equal(spark, sf_dir):
    """The permutation table of each pair against its dense H, and against that with one value changed."""
    both = _pairs(spark, sf_dir).withColumn("table", tables.build("a", "b")).withColumn("h", tables.build_h("a", "b"))
    changed = F.concat(F.array(F.transform(F.get("h", F.lit(0)), lambda v: v + 1)), F.slice("h", 2, F.size("h") - 1))
    return both.select("a", "b", tables.equals_dense("table", "h").alias("same"), tables.equals_dense("table", changed).alias("other"))


def matrix_dump(spark, sf_dir):
    """The rows of a sparse product as text, infinity where there is none."""
    return tropical.dump(min_plus(spark, sf_dir), 32)


def vector_times_table(spark, sf_dir):
    """A vector times H of each pair's table, by runs of candidates and by the definition."""
    built = _pairs(spark, sf_dir).withColumn("table", tables.build("a", "b"))
    size = F.char_length("a") + F.char_length("b")
    vector = F.transform(F.sequence(F.lit(0), size), lambda i: (2 * (size - i)).cast("long"))
    both = built.withColumn("v", vector).select("a", "b", tables.times_h("v", "table").alias("x"), tables.times_h("v", "table", fast=False).alias("y"))
    return both.select("a", "b", (F.col("x") == F.col("y")).alias("agree"), F.size("x").cast("long").alias("n"))


QUERIES = {f.__name__: f for f in (
    min_plus, max_plus, max_plus_part, vector_max_plus, matrix_equal, matrix_fill, distribution, density, unfold_h, h_inverse, permutation_matrix, permutation_inverse, permutation_valid, permutation_swap,
    permutation_sum, unit_monge, unit_monge_definition, cell_tables, table_apply, table_stack, table_beside, table_reduce, dense_stack, dense_beside, h_stack, h_beside, block_repository, table_equal, matrix_dump, vector_times_table,
)}

A = "SELECT l_linenumber::BIGINT AS i, month(l_shipdate) AS j, sum(l_quantity)::BIGINT AS v FROM lineitem GROUP BY ALL"
B = "SELECT month(o_orderdate) AS i, day(o_orderdate) AS j, count(*) AS v FROM orders GROUP BY ALL"
P = "SELECT n_nationkey::BIGINT AS r, row_number() OVER (ORDER BY n_name, n_nationkey) - 1 AS c FROM nation"
Q = "SELECT n_nationkey::BIGINT AS r, row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS c FROM nation"
SIGMA = "SELECT i, j, count(r) AS v FROM (SELECT unnest(range(0, (SELECT count(*) + 1 FROM {p}))) AS i) CROSS JOIN (SELECT unnest(range(0, (SELECT count(*) + 1 FROM {p}))) AS j) LEFT JOIN {p} ON r >= i AND c < j GROUP BY ALL"
PRODUCT = f"""WITH p AS ({P}), q AS ({Q}), sp AS ({SIGMA.format(p="p")}), sq AS ({SIGMA.format(p="q")}),
  m AS (SELECT sp.i, sq.j, min(sp.v + sq.v) AS v FROM sp JOIN sq ON sp.j = sq.i GROUP BY ALL),
  d AS (SELECT i, j, lead(v) OVER (PARTITION BY i ORDER BY j) - v AS d FROM m),
  w AS (SELECT i, j, d - lead(d) OVER (PARTITION BY j ORDER BY i) AS w FROM d) SELECT i AS r, j AS c FROM w WHERE w = 1"""
PREFIXES = f"SELECT a, b, unnest(range(0, len(r))) AS j, unnest(r) AS lcs {LAST}"

ORACLES = {
    "min_plus": f"WITH a AS ({A}), b AS ({B}) SELECT a.i, b.j, min(a.v + b.v) AS v FROM a JOIN b ON a.j = b.i GROUP BY ALL",
    "max_plus": f"WITH a AS ({A}), b AS ({B}) SELECT a.i, b.j, max(a.v + b.v) AS v FROM a JOIN b ON a.j = b.i GROUP BY ALL",
    "max_plus_part": f"WITH a AS ({A}), b AS ({B}) SELECT a.i - 2 AS i, b.j - 5 AS j, max(a.v + b.v) AS v FROM a JOIN b ON a.j = b.i WHERE a.i BETWEEN 2 AND 5 AND a.j BETWEEN 1 AND 9 AND b.j BETWEEN 5 AND 19 GROUP BY ALL",
    "vector_max_plus": f"WITH b AS ({B}), v AS (SELECT month(o_orderdate) AS i, count(*) AS x FROM orders GROUP BY ALL) SELECT j, max(v + x) AS value, arg_max(i, struct_pack(s := v + x, n := -i)) AS pos FROM b JOIN v USING (i) GROUP BY j",
    "matrix_equal": "SELECT true AS same, false AS other",
    "matrix_fill": "SELECT s_suppkey, i, unnest(range(0, 1 + s_nationkey % 5)) AS j, s_suppkey::BIGINT AS v FROM (SELECT *, unnest(range(0, s_suppkey % 4)) AS i FROM supplier)",
    "distribution": f"WITH p AS ({P}) {SIGMA.format(p='p')}",
    "density": f"WITH p AS ({P}) SELECT a.r AS i, b.c AS j, CASE WHEN a.c = b.c THEN 1 ELSE 0 END::BIGINT AS v FROM p a CROSS JOIN p b",
    "unfold_h": f"WITH p AS ({P}), s AS ({SIGMA.format(p='p')}) SELECT i, j, j - (i - 10) - v AS v FROM s",
    "h_inverse": f"WITH p AS ({P}) {SIGMA.format(p='p')}",
    "permutation_matrix": f"SELECT r AS i, c AS j, 1::BIGINT AS v FROM ({P})",
    "permutation_inverse": f"SELECT c AS r, r AS c FROM ({P})",
    "permutation_valid": "SELECT true AS valid",
    "permutation_swap": f"SELECT (SELECT count(*) FROM nation) - 1 - r AS r, (SELECT count(*) FROM nation) - 1 - c AS c FROM ({P})",
    "permutation_sum": f"SELECT r, c FROM ({P}) UNION ALL SELECT r + (SELECT count(*) FROM nation), c + (SELECT count(*) FROM nation) FROM ({Q})",
    "unit_monge": PRODUCT,
    "unit_monge_definition": PRODUCT,
    "cell_tables": """SELECT DISTINCT o_orderstatus AS a, l_linestatus AS b, CASE WHEN a = b THEN '0,1' ELSE '1,0' END AS perm,
      '1,1,1,0,' || (a = b)::INT || ',1,-1,0,1' AS h, '0,1,far,1,' || (a <> b)::INT || ',1,far,1,0' AS distance FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "table_apply": _lcs(PAIRS, False, PREFIXES),
    "table_stack": _lcs(PAIRS, False, PREFIXES + " AND length(a) > 1"),
    "table_beside": _lcs(PAIRS, False, PREFIXES + " AND length(b) > 1"),
    "table_reduce": _lcs(PAIRS, False, PREFIXES),
    "dense_stack": f"SELECT a, b, j, levenshtein(a, substr(b, 1, j))::BIGINT AS distance FROM (SELECT a, b, unnest(range(0, length(b) + 1)) AS j FROM ({PAIRS})) WHERE length(a) > 1",
    "dense_beside": f"SELECT a, b, j, levenshtein(a, substr(b, 1, j))::BIGINT AS distance FROM (SELECT a, b, unnest(range(0, length(b) + 1)) AS j FROM ({PAIRS})) WHERE length(b) > 1",
    "h_stack": _lcs(PAIRS, False, PREFIXES + " AND length(a) > 1"),
    "h_beside": _lcs(PAIRS, False, PREFIXES + " AND length(b) > 1"),
    "block_repository": f"SELECT a, b, true AS agree, 4 * length(a) * length(b) AS cells FROM ({PAIRS})",
    "table_equal": f"SELECT a, b, true AS same, false AS other FROM ({PAIRS})",
    "matrix_dump": f"""WITH a AS ({A}), b AS ({B}), c AS (SELECT a.i, b.j, min(a.v + b.v) AS v FROM a JOIN b ON a.j = b.i GROUP BY ALL)
      SELECT i, string_agg(coalesce(v::VARCHAR, '∞'), ' ' ORDER BY j) AS line FROM (SELECT DISTINCT i FROM c) CROSS JOIN (SELECT unnest(range(0, 32)) AS j) LEFT JOIN c USING (i, j) GROUP BY i""",
    "vector_times_table": f"SELECT a, b, true AS agree, length(a) + length(b) + 1 AS n FROM ({PAIRS})",
}
