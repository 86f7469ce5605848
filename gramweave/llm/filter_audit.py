"""Interaction audit of document filters by the subset-zeta transform.

Each document has a mask of the filters that it fails. The masks are counted by part; the zeta
transform of the counts gives, for every subset of the filters, the documents that fail within that
subset only, and so those that survive any set of filters. What a filter removes at a step of an order is the difference
of two neighbouring sets of survivors, for all documents and for labelled ones alike, so no order is ever run.

Texts are read once and leave a digest, a mask and a part; identical texts are found by their SHA-256. The first of a
text is met again by digest and doc_id, so that a large group of copies is no key of its own.

Defined cases: null text is the empty text; null part is the part "", together with rows whose part is the empty
string; a row of null doc_id has no smaller doc_id and makes no other row a copy; of rows that share doc_id and text none is a
copy of the other; a document has a label if any of its rows in the label table says so, however often; an empty table gives no
row; columns that the audit doesn't name may have any name and play no part.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramweave.operators.spread import spread

from ._base import bounded, picked, stash

SPACE = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


#: The failure conditions that look at one document (fixed values), of `text`, `words` and `chars`; SQL or columns.
LOCAL: dict[str, str | Column] = {
    "A": "size(words) < 50",
    "B": "100 * size(array_distinct(words)) < 65 * size(words)",
    "C": "100 * char_length(regexp_replace(text, '[^A-Z]+', '')) > 5 * chars",
    "D": "text rlike '[#$%&*|]'",
}
#: The filter that looks at the whole table: the text of a smaller doc_id.
COPY = "E"
#: Filters at most: a part has a count for each subset, and a row for each step of each order.
MOST = 7


def masks(docs: DataFrame, conditions: Mapping[str, str | Column] = LOCAL, copy: str | None = COPY, part: str = "source") -> DataFrame:
    """(doc_id, part, mask, n): which filters rows of a doc_id, part and text fail (bit k: the k-th one), and how many rows they are."""
    letters = [*conditions, *([copy] if copy else [])]
    if len(letters) > MOST:
        raise ValueError(f"{len(letters)} filters have {factorial(len(letters))} orders; at most {MOST} are audited")
    rows = picked(docs, "doc_id", "text", part).toDF("doc_id", "text", "part").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"))
    seen = rows.withColumns({"words": _words(F.col("text")), "chars": F.char_length("text")})
    bits = [F.when(F.expr(condition) if isinstance(condition, str) else condition, 1 << k).otherwise(0) for k, condition in enumerate(conditions.values())]
    marked = seen.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits, F.lit(0)).alias("mask"))
    counted = stash(marked.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "masks")
    if not copy:
        return counted.drop("digest")
    first = counted.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"))
    met = counted.join(first.select(F.col("digest").alias("of"), "first"), (F.col("digest") == F.col("of")) & (F.col("doc_id") == F.col("first")), "left")
    is_copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return met.select("doc_id", "part", (F.col("mask") + F.when(is_copy, 1 << (len(letters) - 1)).otherwise(0)).alias("mask"), "n")


def survivors(marked: DataFrame, filters: int, sums: Mapping[str, Column]) -> DataFrame:
    """(part, and for each sum an array): at place S, the sum over rows that fail no filter of the set S."""
    full = (1 << filters) - 1
    masked = marked.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(name) for name, c in sums.items()])
    # one row a part: a sum for each mask, zero where none has it
    dense = masked.groupBy("part").agg(*[F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(name))), F.lit(0)).cast("long") for m in range(full + 1)]).alias(name) for name in sums])
    for k in range(filters):  # a projection a bit, so that no array is built twice
        dense = dense.select("part", *[_step(F.col(name), 1 << k).alias(name) for name in sums])
    return dense.select("part", *[F.reverse(name).alias(name) for name in sums])  # the subsets of what is not in S


def _step(values: Column, bit: int) -> Column:
    """One bit of the zeta transform: what lacks the bit is added to what has it."""
    return F.transform(values, lambda v, m: v + F.when(m.bitwiseAND(F.lit(bit)) != 0, F.get(values, m.bitwiseXOR(F.lit(bit)))).otherwise(F.lit(0)))


def _orders(letters: str) -> tuple[Column, Column, Column]:
    """Arrays of all orders, and by order and step the set before it and the filter."""
    orders = list(permutations(range(len(letters))))
    names = ["".join(letters[k] for k in order) for order in orders]
    before = [[sum(1 << k for k in order[:step]) for step in range(len(order))] for order in orders]
    return F.split(F.lit(",".join(names)), ","), F.lit(before), F.lit([list(order) for order in orders])


def audit(docs: DataFrame, labels: DataFrame, conditions: Mapping[str, str | Column] = LOCAL, copy: str | None = COPY, part: str = "source", lost: Mapping[str, str] = {"good_lost": "quality", "toxic_lost": "toxic"}) -> DataFrame:  # noqa: B006
    """A row for each part, order of the filters and step: what is kept, removed here, removed before although it fails here, failing here alone, labelled and removed here, and the filter's share over all orders."""
    letters = "".join(conditions) + (copy or "")
    n = len(letters)
    flags = picked(labels, "doc_id", *lost.values()).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(*[F.max((F.col(c) == 1).cast("int")).alias(name) for name, c in lost.items()])
    marked = masks(docs, conditions, copy, part).join(bounded(stash(flags, "labels"), 16), F.col("doc_id") == F.col("id"), "left")
    sums = {"rows": F.col("n")} | {name: F.col("n") * F.coalesce(name, F.lit(0)) for name in lost}
    left = survivors(marked, n, sums)
    names, before, order = _orders(letters)
    all_of = (1 << n) - 1
    # how many orders have exactly the set S before a filter outside of it
    weights = F.lit([factorial(s.bit_count()) * factorial(max(0, n - 1 - s.bit_count())) for s in range(all_of + 1)])
    outside = lambda f: F.filter(F.sequence(F.lit(0), F.lit(all_of)), lambda s: s.bitwiseAND(f) == 0)
    share = lambda f: F.aggregate(outside(f), F.lit(0).cast("long"), lambda total, s: total + F.get(weights, s) * (F.get("rows", s) - F.get("rows", s.bitwiseOR(f))))
    shares = left.select("*", F.array(*[share(F.lit(1 << k)) for k in range(n)]).alias("shares"))
    steps = shares.select("*", F.posexplode(names).alias("no", "filter_order")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("at"))
    steps = steps.select("*", F.get(F.get(before, F.col("no")), F.col("at")).alias("before"), F.get(F.get(order, F.col("no")), F.col("at")).alias("k"))
    bit = F.element_at(F.lit([1 << k for k in range(n)]), F.col("k") + 1)
    steps = steps.select("*", bit.alias("bit"), F.col("before").bitwiseOR(bit).alias("after"))
    gone = lambda name: F.get(name, F.col("before")) - F.get(name, F.col("after"))
    fails = F.get("rows", F.lit(0)) - F.get("rows", F.col("bit"))
    alone = F.get("rows", F.lit(all_of).bitwiseXOR(F.col("bit"))) - F.get("rows", F.lit(all_of))
    return steps.select(
        "part", "filter_order", (F.col("at") + 1).cast("int").alias("step"),
        F.get("rows", F.col("after")).alias("kept"), gone("rows").alias("removed"), (fails - gone("rows")).alias("redundant"), alone.alias("unique_fails"),
        *[gone(name).alias(name) for name in lost], F.get("shares", F.col("k")).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
failing AS (SELECT part, doc_id,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS mask FROM words),
flags AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
counted AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failing LEFT JOIN flags USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(range(5)) AS f),
orders AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT array_to_string(list_transform(o, lambda x: chr(65 + x::INT)), '') AS filter_order, s AS step, o[s] AS f,
    list_sum(list_transform(o[:s - 1], lambda x: 1 << x::INT))::INT AS before_set FROM orders, (SELECT unnest(range(1, 6)) AS s)),
sets AS (SELECT filter_order, step::INT AS step, f, coalesce(before_set, 0) AS before_set, (1 << f::INT)::INT AS bit FROM steps),
found AS (SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER ((mask & (before_set | bit)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER ((mask & before_set) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER ((mask & before_set) <> 0 AND (mask & bit) <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER ((mask & before_set) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER ((mask & before_set) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS toxic_lost
  FROM counted, sets GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM found
"""
