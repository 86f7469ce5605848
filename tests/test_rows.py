"""Operators that keep permutations, grids and grammars as rows, against kernels and definitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramweave.functions import seaweed, strings
from gramweave.operators import monge, places, shared, trials, tropical, wavefront


def test_running_sums_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", None, "b"]), rng.randrange(50), rng.randrange(5), k) for k in range(500)]
    table = spark.createDataFrame(rows, "key string, v int, w int, no int")
    found = places.running(table, ["key"], ["v", "no"], F.col("w"), parts=7).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.before == sum(w for key, v, w, no in rows if key == r.key and (v, no) < (r.v, r.no))
    assert sorted(r.before for r in places.running(table.select("no"), [], ["no"], parts=5).collect()) == list(range(500))
    assert places.running(table.limit(0), ["key"], ["v"]).collect() == []


@pytest.mark.parametrize(("block", "strip"), [(8, 4), (5, 16), (64, 4)])
def test_product_of_rows(spark, block, strip):
    rng = np.random.default_rng(block)
    perms = {k: (rng.permutation(n), rng.permutation(n)) for k, n in enumerate((1, 2, 7, 40, 61))}
    perms[9] = (np.arange(37), np.arange(37)[::-1].copy())
    perms[10] = (np.arange(33)[::-1].copy(), np.arange(33)[::-1].copy())
    table = lambda side: spark.createDataFrame([(k, r, int(c)) for k, pair in perms.items() for r, c in enumerate(pair[side])], "key long, r long, c long")
    found = monge.product(table(0), table(1), "key", block, strip).collect()
    assert {(x.key, x.r): x.c for x in found} == {(k, r): int(c) for k, (p, q) in perms.items() for r, c in enumerate(seaweed.multiply(p, q))}
    assert len(found) == sum(len(p) for p, _ in perms.values())


def _texts(rng, lengths, letters="abc"):
    return ["".join(rng.choice(letters) for _ in range(n)) for n in lengths]


@pytest.mark.parametrize("kind", ["distance", "subsequence"])
def test_blocks_with_borders(kind):
    """A table cut in any blocks gives what one block gives."""
    rng = random.Random(4)
    for _ in range(60):
        a, b = _texts(rng, (rng.randrange(1, 40), rng.randrange(1, 40)))
        x, y = strings.codes(a), strings.codes(b)
        size, total = rng.randrange(1, 12), 0 if kind == "subsequence" else len(b)
        lower = [None] * -(-len(b) // size)
        for i in range(0, len(a), size):
            left = None
            for k, j in enumerate(range(0, len(b), size)):
                left, lower[k], change = wavefront.BLOCKS[kind](x[i : i + size], y[j : j + size], left, lower[k])
            total += change
        assert total == (strings.bit_distance(x, y) if kind == "distance" else strings.bit_subsequence(x, y))


def test_wavefront(spark):
    rng = random.Random(6)
    a, b = _texts(rng, (50, 1, 33, 64, 7, 16, 0, 5)), _texts(rng, (41, 90, 33, 3, 8, 16, 4, 0), "abcd\U0001f600")
    pairs = spark.createDataFrame([*zip(a, b, strict=True), (a[0], b[0]), (None, "x"), ("x", None)], "a string, b string")
    found = wavefront.wavefront(wavefront.wavefront(pairs, size=16, every=2), kind="subsequence", size=16, into="common").collect()
    assert len(found) == 11
    for r in found:
        if r.a is None or r.b is None:
            assert r.distance is None and r.common is None
        else:
            x, y = strings.codes(r.a), strings.codes(r.b)
            assert r.distance == strings.bit_distance(x, y) and r.common == strings.bit_subsequence(x, y)
    assert wavefront.wavefront(pairs.limit(0)).collect() == []


def test_shared_grammars(spark):
    rng = random.Random(8)
    texts = [*_texts(rng, (1, 2, 3, 17, 40, 64, 64, 31), "ab\U0001f600"), None, ""]
    table = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, texts[4], texts[4][:20]])], "id long, text string")
    grammar = shared.productions(table)
    rows = grammar.collect()
    parts, todo = set(), [t for t in texts if t]
    while todo:
        part = todo.pop()
        if part not in parts:
            parts.add(part)
            cut = (len(part) + 1) // 2
            todo += [part[:cut], part[cut:]] if len(part) > 1 else []
    assert sorted(r.content for r in rows) == sorted(parts) and len({bytes(r.node) for r in rows}) == len(rows)
    assert all(r.size == len(r.content) and (r.left is None) == (r.size == 1) for r in rows)
    asked = table.select("id", F.when(F.char_length("text") > 0, shared.node_of("text")).alias("node"), (F.col("id") % 4 - 1).alias("begin"), (F.col("id") * 7 % 45).alias("end"))
    want = {r.id: (r.text or "")[max(0, r.id % 4 - 1) : r.id * 7 % 45] for r in table.collect()}
    assert {r.id: r.text for r in shared.extract(asked, grammar).collect()} == want
    assert shared.productions(table.limit(0)).collect() == [] and shared.extract(asked.limit(0), grammar).collect() == []


@pytest.mark.parametrize("leaf", [1, 30, shared.LEAF])
def test_repository_of_productions(spark, leaf):
    rng = random.Random(9)
    a, b = _texts(rng, (1, 9, 24, 24, 13)), _texts(rng, (7, 1, 20, 24, 33))
    pairs = spark.createDataFrame([*zip(a, b, strict=True), (a[2], b[4]), (a[2], b[2])], "a string, b string")
    grammar = shared.productions(pairs.select(F.col("a").alias("text")).union(pairs.select("b")))
    found = shared.repository(pairs.select(shared.node_of("a").alias("p"), shared.node_of("b").alias("q")), grammar, leaf)
    content = {bytes(r.node): r.content for r in grammar.collect()}
    rows = found.collect()
    assert len({(bytes(r.p), bytes(r.q)) for r in rows}) == len(rows)
    for r in rows:
        x, y = content[bytes(r.p)], content[bytes(r.q)]
        want = seaweed.combed(strings.codes(x), strings.codes(y))
        assert (r.table.rows, r.table.cols, r.table.perm) == (want.rows, want.cols, want.perm.tolist())
    asked = {(r.a, r.b) for r in pairs.collect()}
    assert asked <= {(content[bytes(r.p)], content[bytes(r.q)]) for r in rows} and (leaf > 1 or len(rows) > 60)
    assert shared.repository(pairs.limit(0).select(F.lit(b"").alias("p"), F.lit(b"").alias("q")), grammar).collect() == []


def test_dominance_and_order_statistics(spark):
    rng = random.Random(11)
    points = [(rng.randrange(20), rng.randrange(15)) for _ in range(70)]
    asked = [(k, rng.randrange(-1, 25), rng.randrange(-1, 18)) for k in range(60)]
    table = spark.createDataFrame(points, "r int, c int")
    questions = spark.createDataFrame(asked, "no int, i int, j int")
    found = tropical.dominance(table, questions).collect()
    assert {x.no: x["count"] for x in found} == {no: sum(r >= i and c < j for r, c in points) for no, i, j in asked} and len(found) == 60
    weighed = tropical.dominance(table, questions, F.col("c") + 1).collect()
    assert {x.no: x["count"] for x in weighed} == {no: sum(c + 1 for r, c in points if r >= i and c < j) for no, i, j in asked}
    assert {x["count"] for x in tropical.dominance(table.limit(0), questions).collect()} == {0}

    rows = [(rng.choice(["hot", "hot", None, "x"]), rng.choice([float(rng.randrange(6)), rng.random()])) for _ in range(300)]
    stats = trials.trial_stats(spark.createDataFrame(rows, "key string, value double"), ["key"], "value").collect()
    assert len(stats) == 3
    for s in stats:
        own = sorted(v for key, v in rows if key == s.key)
        t = len(own)
        assert (s.min, s.lower, s.median, s.upper, s.max) == (own[0], own[(t - 1) // 4], own[t // 2], own[3 * (t - 1) // 4], own[-1])
        assert abs(s.mean - np.mean(own)) < 1e-12 and abs(s.rsd - 100 * np.std(own) / np.mean(own)) < 1e-9


def test_sequence_format(spark, tmp_path):
    """Ranges of any size give each record once; attempts that are not committed leave nothing."""
    import io

    from gramweave.sources import fasta, fasta_format

    rng = random.Random(14)
    text = "".join(rng.choice([">n%d\n" % k, "acgt\n", "ac gt", "\n", ";note\n", ">\n", "g" * 40 + "\n"]) for k in range(300))
    whole = list(fasta_format.records(io.BytesIO(text.encode()), 0, len(text)))
    for size in (1, 7, 64, 1000):
        found = [r for at in range(0, len(text), size) for r in fasta_format.records(io.BytesIO(text.encode()), at, min(len(text), at + size))]
        assert found == whole
    path = tmp_path / "x.fa"
    path.write_text(text)
    known = sorted((r.name, r.seq) for r in fasta.read(spark, str(path)).where("record > 0").collect())
    assert sorted((n, s) for _, n, s in whole) == known and len(known) > 50

    fasta_format.register(spark)
    read = spark.read.format("fasta").option("rangeBytes", 100).load(str(path))
    assert sorted((r.name, r.seq) for r in read.collect()) == known and read.rdd.getNumPartitions() > 5
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"r{k}", "acgt" * k, 1) for k in range(90)], "name string, seq string, more int").repartition(5)
    rows.write.format("fasta").mode("append").save(out)
    assert {(r.name, r.seq) for r in spark.read.format("fasta").load(out).collect()} == {(f"r{k}", "acgt" * k) for k in range(1, 90)} | {(r.name, r.seq) for r in spark.read.format("fasta").load(out).where("seq = ''").collect()}
    writer = fasta_format.FastaWriter({"path": out}, ["name", "seq"], True)
    first, again = (writer.write(iter([("twice", "tt")])) for _ in range(2))  # a task and its repetition
    assert first.staged != again.staged
    writer.commit([again, None])
    assert [(r.name, r.seq) for r in spark.read.format("fasta").load(out).collect()] == [("twice", "tt")]
    writer.write(iter([("lost", "aa")]))
    writer.abort([])
    assert [(r.name, r.seq) for r in spark.read.format("fasta").load(out).collect()] == [("twice", "tt")]
    with pytest.raises(ValueError):
        fasta_format.FastaWriter({"path": out}, ["name"], False)


def test_turns_without_text_keep_their_row(spark, tmp_path):
    """As in the SQL: no text has no length, and an empty one the length 0; both agree with having no productions."""
    from gramweave.plans import grammars

    turns = [(1, 0, "abcabcab"), (1, 1, ""), (2, 0, None), (2, 1, "a")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = grammars.compression_ratio(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(c, t, None if text is None else len(text), True, True, True) for c, t, text in turns]
