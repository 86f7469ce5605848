"""What a task holds, and what work costs, must not grow with the square of the input or with a batch's results."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gramweave.functions import grammar, seaweed
from gramweave.operators import components, grammars, monge, places, shared, tropical, wavefront
from gramweave.sources import fasta_format


def _texts(n, seed=3):
    rng = random.Random(seed)
    return [None, "", "a", "aa", *["".join(rng.choice("abc \n") for _ in range(rng.randrange(1, 60))) for _ in range(n)]]


@pytest.mark.parametrize("given", [1, 7, 1 << 15])
def test_rows_of_texts_are_given_out_in_pieces(spark, given):
    """A batch's results are never held as one: pieces of any size are the same rows."""
    rows = spark.createDataFrame(list(enumerate(_texts(30))), "no long, text string").repartition(1)
    sizes = []

    def run(t):
        sizes.append(len(t))
        return [list(range(len(t))), list(t)]

    found = grammars._rows_of(rows, "text", ["no"], run, "at long, c string", given).collect()
    assert sorted(map(tuple, found)) == [(no, k, c) for no, t in enumerate(_texts(30)) if t for k, c in enumerate(t)]


@pytest.mark.parametrize("builder", list(grammar.BUILDERS))
def test_productions_stream(spark, builder):
    rows = spark.createDataFrame(list(enumerate(_texts(20))), "no long, text string")
    found = grammars.productions(rows, "text", ["no"], builder)
    assert "MapInArrow" in found._jdf.queryExecution().toString() and "ArrowEvalPython" not in found._jdf.queryExecution().toString()
    counts = {r.no: (r.n, r.size) for r in found.groupBy("no").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("size")).collect()}
    assert counts == {no: (grammar.BUILDERS[builder](t).productions(), len(t)) for no, t in enumerate(_texts(20)) if t}


def test_compressed_makes_few_nodes_that_it_does_not_need():
    """A factor costs what it adds, not the flank of one tree of the whole text."""
    rng = random.Random(5)
    for letters in ("ab", "abcdefghij \n"):
        text = "".join(rng.choice(letters) for _ in range(2000))
        g = grammar.compressed(text)
        assert g.text() == text and len(g.symbol) < 1.6 * g.productions()
        for k in g.reached():
            if g.left[k] >= 0:
                a, b = g.left[k], g.right[k]
                assert abs(g.height[a] - g.height[b]) <= 1 and g.height[k] == 1 + max(g.height[a], g.height[b]) and g.size[k] == g.size[a] + g.size[b]


@pytest.mark.parametrize("builder", ["compressed", "halved"])
def test_measures_walk_a_grammar_once(spark, monkeypatch, builder):
    """Productions are counted once for the number and the ratio, and once blown up."""
    calls, counted = [], grammar.Grammar.reached
    monkeypatch.setattr(grammar.Grammar, "reached", lambda g: calls.append(1) or counted(g))
    seen = {}
    monkeypatch.setattr(grammars, "kernel", lambda run, schema: seen.update(run=run) or (lambda c: c))
    monkeypatch.setattr(grammars, "_measured", lambda measure: measure)
    with pytest.raises(Exception):  # noqa: B017 - only the measure is wanted
        grammars.compression(spark.range(1).select(F.lit("a").alias("text")), "text", [], builder).select("nothing")
    found = seen["run"]("abcabcabcab")
    g = grammar.BUILDERS[builder]("abcabcabcab")
    assert len(calls) == 3 and found["ratio"] == g.ratio() and found["n_productions"] == g.productions() and found["blown_productions"] == g.productions() + 4


def test_measures_are_held_as_columns():
    """Of a batch's texts at most two results are held as such; the numbers are the same."""
    held, most = [], []

    class Result(dict):
        def __init__(self, *a, **b):
            super().__init__(*a, **b)
            held.append(1)
            most.append(len(held))

        def __del__(self):
            held.pop()

    texts = ["", *(t or "" for t in _texts(200)), None]
    found = grammars._measured(lambda t: Result(n=len(t), ratio=None if not t else 1 / len(t)))(pd.Series(texts, dtype=object))
    assert found["n"].tolist() == [len(t or "") for t in texts] and found["ratio"].isna().tolist() == [not t for t in texts]
    assert max(most) <= 2


def test_partition_streams(spark):
    rows = spark.createDataFrame(list(enumerate(_texts(20))), "no long, text string")
    found = grammars.partition(rows, "text", ["no"])
    assert "MapInArrow" in found._jdf.queryExecution().toString() and "ArrowEvalPython" not in found._jdf.queryExecution().toString()
    texts = {}
    for r in sorted(found.collect(), key=lambda r: (r.no, r.pos)):
        texts[r.no] = texts.get(r.no, "") + r.content
    assert texts == {no: t for no, t in enumerate(_texts(20)) if t}


def test_intervals_are_one_pass(spark):
    """A frame that ends at the last row is read anew for every row."""
    points = spark.range(5000).select((F.col("id") % 2).alias("by"), F.col("id").alias("x"))
    removed = points.where("x % 7 > 1").select("x")
    found = components.interval_find(points, removed, by="by")
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    ends = {b: [x for x in range(5000) if x % 2 == b and x % 7 <= 1] for b in (0, 1)}
    want = {(b, x): next((e for e in ends[b] if e >= x), None) for b in (0, 1) for x in range(b, 5000, 2)}
    assert {(r.by, r.x): r["last"] for r in found.collect()} == want


def test_small_ranges_share_tasks(tmp_path, monkeypatch):
    """However small the ranges are, there are few tasks, which cover each byte once."""
    (tmp_path / "a.fasta").write_text("".join(f">n{k}\n{'acgt' * 9}\n" for k in range(3000)))
    reader = fasta_format.FastaReader({"path": str(tmp_path), "rangeBytes": "64"})
    monkeypatch.setattr(fasta_format, "TASKS", 16)
    parts = reader.partitions()
    assert len(parts) <= 17 and parts[0].begin == 0 and all(a.end == b.begin for a, b in zip(parts, parts[1:]))
    assert sorted(r[2] for p in parts for r in reader.read(p)) == sorted(f"n{k}" for k in range(3000))
    monkeypatch.setattr(fasta_format, "TASKS", 1 << 20)
    assert len(reader.partitions()) > 2000


@pytest.mark.parametrize("leaf", [1, 2, 5, 64])
def test_ranges_from_productions_with_leaves(spark, leaf):
    """Larger leaves are fewer productions and rounds, and read the same ranges."""
    rng = random.Random(8)
    texts = ["x", "ab", *["".join(rng.choice("abc\U0001f600") for _ in range(rng.randrange(1, 90))) for _ in range(12)]]
    asked = [(k, t, a, a + rng.randrange(0, 40)) for k, t in enumerate(texts) for a in (0, len(t) // 3, len(t) - 1, len(t) + 3)]
    rows = spark.createDataFrame([(i, *x[1:]) for i, x in enumerate(asked)], "id long, text string, begin long, end long")
    table = shared.productions(rows, leaf=leaf)
    found = shared.extract(rows.select("id", shared.node_of("text").alias("node"), "begin", "end"), table)
    assert {r.id: r.text for r in found.collect()} == {i: t[a:b] for i, (_, t, a, b) in enumerate(asked)}
    sizes = [r.size for r in table.select("size").collect()]
    assert leaf == 1 or min(s for s in sizes if s not in map(len, texts)) > leaf if leaf < 40 else True


def test_dominance_deals_in_ranges_of_bounded_rows(spark, monkeypatch):
    dealt, run = [], places.running
    monkeypatch.setattr(tropical, "running", lambda *a, parts=None, **b: dealt.append(parts) or run(*a, parts=parts, **b))
    monkeypatch.setattr(tropical, "RANGE", 50)
    rng = random.Random(9)
    points = [(rng.randrange(60), rng.randrange(60)) for _ in range(300)]
    asked = [(rng.randrange(64), rng.randrange(64)) for _ in range(40)]
    found = tropical.dominance(spark.createDataFrame(points, "r long, c long"), spark.createDataFrame(asked, "i long, j long")).collect()
    assert sorted(map(tuple, found)) == sorted((i, j, sum(r >= i and c < j for r, c in points)) for i, j in asked)
    assert dealt[0] >= 340 * 6 // (2 * 50)


@pytest.mark.parametrize("kind", ["distance", "subsequence"])
def test_small_blocks_are_taken_many_at_once(spark, monkeypatch, kind):
    rows = spark.createDataFrame([("abcabcd" * k, "abdacb" * (5 - k), k) for k in range(1, 5)], "a string, b string, k int")
    found = wavefront.wavefront(rows, kind=kind, size=4, every=100)
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInArrow" not in plan
    monkeypatch.setattr(wavefront, "SMALL", 0)
    assert sorted(found.collect()) == sorted(wavefront.wavefront(rows, kind=kind, size=4).collect())


def test_repository_cuts_pairs_not_parts(spark, tmp_path, monkeypatch):
    """However many parts have a name and a type, these are cut once."""
    from gramweave.plans import algebra
    from gramweave.sources import scratch

    parts = [("abc def", "XYZ AB"), ("abd", "XY"), ("b a", "ZZ TOP")]
    spark.createDataFrame([(k, *parts[k % 3]) for k in range(300)], "p_partkey int, p_name string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    plans = []
    monkeypatch.setattr(algebra, "written", lambda table, tag: plans.append(table._jdf.queryExecution().optimizedPlan().toString()) or scratch.written(table, tag), raising=False)
    found = algebra.block_repository(spark, str(tmp_path))
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    for plan in plans:
        lines = plan.splitlines()
        if any("Aggregate" in line and "p_type" in line for line in lines):
            last = max(k for k, line in enumerate(lines) if "Aggregate" in line)
            assert not any("EvalPython" in line for line in lines[last:])
    assert sorted(map(tuple, found.collect())) == sorted((a.upper(), b, True, 4 * len(a) * len(b)) for a, b in parts)


@pytest.mark.parametrize(("together", "blocks", "block", "strip"), [(0, 32, 4, 1), (0, 4, 1, 3), (0, 32, 2, 64), (30, 8, 5, 2), (1 << 16, 32, 8, 8)])
def test_product_of_rows_small_and_large(spark, monkeypatch, together, blocks, block, strip):
    """Small keys are multiplied many at once; the others are merged with few places of their strips. Both are the same products."""
    rng = np.random.default_rng(block)
    perms = {f"k{n}-{m}": (rng.permutation(n), rng.permutation(n)) for n in (1, 2, 3, 17, 40, 75) for m in range(3)}
    perms["id"], perms["up"] = (np.arange(37), np.arange(37)[::-1].copy()), (np.arange(53)[::-1].copy(), np.arange(53)[::-1].copy())
    perms["near"] = (np.argsort(np.arange(64) + rng.integers(0, 9, 64), kind="stable"), np.argsort(np.arange(64) + rng.integers(0, 9, 64), kind="stable"))
    for name, value in (("TOGETHER", together), ("BLOCKS", blocks), ("CELLS", 64), ("MATCHED", 32)):
        monkeypatch.setattr(monge, name, value, raising=False)
    table = lambda side: spark.createDataFrame([(k, r, int(c)) for k, pair in perms.items() for r, c in enumerate(pair[side])], "key string, r long, c long")
    product = monge.product(table(0), table(1), "key", block, strip)
    if together > 75:
        assert "MapInArrow" in product._jdf.queryExecution().toString()
    found = product.collect()
    assert sorted((x.key, x.r, x.c) for x in found) == sorted((k, r, int(c)) for k, (p, q) in perms.items() for r, c in enumerate(seaweed.multiply(p, q)))


def test_places_of_all_rows_deal_them_once(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(rng.randrange(40), k) for k in range(700)], "v int, no int")
    found = places.running(rows, [], ["v", F.desc("no")], into="at", parts=9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_at" not in plan and "windowspecdefinition(_at" not in plan
    order = {r: k for k, r in enumerate(sorted(map(tuple, rows.collect()), key=lambda r: (r[0], -r[1])))}
    assert {(r.v, r.no): r["at"] for r in found.collect()} == order
    assert places.running(rows.limit(0), [], ["v"]).collect() == []


def test_few_questions_move_no_points(spark, monkeypatch):
    monkeypatch.setattr(tropical, "running", lambda *a, **b: pytest.fail("points are dealt"))
    rng = random.Random(4)
    points = [(rng.randrange(60), rng.randrange(60), rng.randrange(5)) for _ in range(300)]
    asked = [(rng.randrange(-2, 64), rng.randrange(-2, 64)) for _ in range(14)] + [(7, 7), (7, 7), (0, 60)]
    found = tropical.dominance(spark.createDataFrame(points, "r long, c long, w long"), spark.createDataFrame(asked, "i long, j long"), F.col("w")).collect()
    assert sorted(map(tuple, found)) == sorted((i, j, sum(w for r, c, w in points if r >= i and c < j)) for i, j in asked)


def test_small_products_are_one_step(monkeypatch):
    """A product of few rows needs no rounds."""
    rng = np.random.default_rng(6)
    pairs = [(rng.permutation(n), rng.permutation(n)) for n in range(seaweed.SMALL + 1) for _ in range(20)]
    want = [seaweed.multiply_many(p, q, np.array([0, len(p)])) for p, q in pairs]
    monkeypatch.setattr(seaweed, "multiply_many", lambda *a: pytest.fail("rounds"))
    for (p, q), right in zip(pairs, want):
        found = seaweed.multiply(p, q)
        assert found.dtype == np.int64 and found.tolist() == right.tolist()
