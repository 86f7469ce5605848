"""Queries on repeated measurements: order lines as trials, their numbers as iterations, their flags as stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gramweave.operators import trials
from gramweave.plans.distances import table


def _stats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("iteration"), F.col("l_returnflag").alias("stage"), "l_quantity")
    return trials.trial_stats(rows, ["iteration", "stage"], "l_quantity")


def trial_stats(spark, sf_dir):
    """Order statistics, mean and relative deviation of event values by type."""
    found = trials.trial_stats(table(spark, sf_dir, "events"), ["event_type"], "value")
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "rsd")})


def stage_totals(spark, sf_dir):
    return trials.totals(_stats(spark, sf_dir), ["iteration"])


def stage_shares(spark, sf_dir):
    found = trials.stage_shares(_stats(spark, sf_dir), "iteration", "stage")
    return found.select("iteration", "stage", F.round("share", 6).alias("share"), F.round("stacked", 6).alias("stacked"))


def speedups(spark, sf_dir):
    """Medians of one stage over another, aligned by iteration."""
    stats = _stats(spark, sf_dir)
    return trials.speedup(stats.where("stage = 'A'"), stats.where("stage = 'N'")).withColumn("speedup", F.round("speedup", 6))


def sweep_order(spark, sf_dir):
    """For each supplier a grid of factors, outwards from the remainder of its key."""
    return trials.sweep_grids(table(spark, sf_dir, "supplier"), "s_suppkey", (F.col("s_suppkey") % 7).cast("double"), step=0.6)


def heat_map(spark, sf_dir):
    found = trials.heat_map(_stats(spark, sf_dir), "iteration", "stage", "median", ["A", "N", "R"])
    return found.select("iteration", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


def head_tail(spark, sf_dir):
    """The two first and the two last iterations of each stage."""
    stats = _stats(spark, sf_dir).select("stage", "iteration", "median")
    return trials.head(stats, 2, "iteration", ["stage"]).withColumn("end", F.lit("head")).unionByName(trials.head(stats, 2, "iteration", ["stage"], last=True).withColumn("end", F.lit("tail")))


def row_filter(spark, sf_dir):
    """Groups of a list, and the rows of one group above a bound."""
    rows = table(spark, sf_dir, "part")
    kept = rows.where(F.col("p_size").isin(1, 10, 20, 50) & ((F.col("p_size") != 50) | (F.col("p_retailprice") > 950)))
    return kept.groupBy("p_size").agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("least"))


def norms(spark, sf_dir):
    """The normalised series, with order sizes for lengths and quantities for times."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("t"), F.count_distinct("l_suppkey").alias("p"), F.count_distinct("l_partkey").alias("q"))
    n, t, p, q = (F.col(c) for c in "ntpq")
    quality, deep = trials.compression_norm(p, F.col("l_linenumber"), n)
    out = {"table_norm": trials.table_norm(t, p, q, p, q), "grid_norm": trials.grid_norm(t, n, p), "total_norm": trials.total_norm(t, n, p), "misses": trials.miss_percent(p, q), "quality": quality, "deep": deep, "base": trials.base_case_size(n), "theory": trials.theory_ratio(t, q, n)}
    return rows.select("l_linenumber", *[F.round(F.log2(v), 5).alias(k) for k, v in out.items()])


QUERIES = {f.__name__: f for f in (trial_stats, stage_totals, stage_shares, speedups, sweep_order, heat_map, head_tail, row_filter, norms)}

STATS = """SELECT {by}, v[1] AS "min", v[(n - 1) // 4 + 1] AS lower, v[n // 2 + 1] AS median, v[3 * (n - 1) // 4 + 1] AS upper, v[n] AS "max"{more}
  FROM (SELECT {by}, list_sort(list({value})) AS v, count(*) AS n, avg({value}) AS m, stddev_pop({value}) AS d FROM {source} GROUP BY ALL)"""
STAGES = "WITH s AS (" + STATS.format(by="iteration, stage", value="l_quantity", more="", source="(SELECT l_linenumber AS iteration, l_returnflag AS stage, l_quantity FROM lineitem)") + ")"

ORACLES = {
    "trial_stats": STATS.format(by="event_type", value="value", more=", round(m, 4) AS mean, round(100 * d / m, 4) AS rsd", source="events"),
    "stage_totals": STAGES + ' SELECT iteration, 0::DOUBLE AS "min", 0::DOUBLE AS lower, sum(median) AS median, 0::DOUBLE AS upper, 0::DOUBLE AS "max", 0::DOUBLE AS mean, 0::DOUBLE AS rsd FROM s GROUP BY iteration',
    "stage_shares": STAGES + ", h AS (SELECT iteration, stage, median / sum(median) OVER (PARTITION BY iteration) AS share FROM s) SELECT iteration, stage, round(share, 6) AS share, round(sum(share) OVER (PARTITION BY iteration ORDER BY stage), 6) AS stacked FROM h",
    "speedups": STAGES + " SELECT a.iteration, round(a.median / n.median, 6) AS speedup FROM s a LEFT JOIN s n ON a.iteration = n.iteration AND n.stage = 'N' WHERE a.stage = 'A'",
    "sweep_order": """WITH a AS (SELECT round(k * 0.6, 6) AS f FROM (SELECT unnest(range(1, 11))::DOUBLE AS k)), s AS (SELECT s_suppkey, (s_suppkey % 7)::DOUBLE AS c FROM supplier)
      SELECT s_suppkey, x.f AS xfactor, y.f AS ffactor, row_number() OVER (PARTITION BY s_suppkey ORDER BY round(pow(x.f - c, 2) + pow(y.f - c, 2), 6), x.f, y.f) AS seq FROM s, a x, a y""",
    "heat_map": STAGES + " SELECT iteration, max(median) FILTER (stage = 'A') AS a, max(median) FILTER (stage = 'N') AS n, max(median) FILTER (stage = 'R') AS r FROM s GROUP BY iteration",
    "head_tail": STAGES + """ SELECT stage, iteration, median, 'head' AS "end" FROM s QUALIFY row_number() OVER (PARTITION BY stage ORDER BY iteration) <= 2
      UNION ALL SELECT stage, iteration, median, 'tail' FROM s QUALIFY row_number() OVER (PARTITION BY stage ORDER BY iteration DESC) <= 2""",
    "row_filter": "SELECT p_size, count(*) AS n, min(p_retailprice) AS least FROM part WHERE p_size IN (1, 10, 20, 50) AND (p_size <> 50 OR p_retailprice > 950) GROUP BY p_size",
    "norms": """WITH g AS (SELECT l_linenumber, count(*)::DOUBLE AS n, sum(l_quantity) AS t, count(DISTINCT l_suppkey)::DOUBLE AS p, count(DISTINCT l_partkey)::DOUBLE AS q FROM lineitem GROUP BY l_linenumber)
      SELECT l_linenumber, round(log2(t / (pow(p + q, 2) * (p + q) * log2(p + q))), 5) AS table_norm, round(log2(t / (pow(n, 2) / p)), 5) AS grid_norm, round(log2(t / (n * p * log2(greatest(n / p, 2)))), 5) AS total_norm,
        round(log2(100 * q / (p + q)), 5) AS misses, round(log2(p / (l_linenumber + 2)), 5) AS quality, round(log2(p / (l_linenumber + 2) / log2(n)), 5) AS deep,
        round(log2(n / pow(2, ceil(log2(n / 50)))), 5) AS base, round(log2((t / q) / (n / pow(log2(n), 2.5))), 5) AS theory FROM g""",
}
