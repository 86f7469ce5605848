import random

import pytest
from pyspark.sql import functions as F

from gramweave.operators import components, trials, tropical
from gramweave.sources import fasta, generate, measurements
from gramweave.streaming import with_distance


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)]
    up = list(range(80))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    nodes = spark.range(80).withColumnRenamed("id", "node")
    found = {r.node: r.root for r in components.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: root(k) for k in range(80)}
    alone = components.components(nodes, spark.createDataFrame([], "a long, b long")).collect()
    assert all(r.node == r.root for r in alone)


@pytest.mark.parametrize("path", [[*range(0, 256, 2), *range(255, 0, -2)], list(range(300, 44, -1))])
def test_components_of_long_paths(spark, path):
    # ids that grow towards the middle, and ones that fall along the path; an edge to a node that isn't there
    edges = spark.createDataFrame([*zip(path, path[1:]), (path[5], -7)], "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in [*path, 1000]], "node long")
    found = {r.node: r.root for r in components.components(nodes, edges).collect()}
    assert found == {**dict.fromkeys(path, min(path)), 1000: 1000}


def test_intervals_that_double(spark):
    n = 256
    points = spark.range(n).withColumnRenamed("id", "x").withColumn("g", F.lit(1))
    for step in (1, 2, 8, 64):
        removed = points.where((F.col("x") + 1) % step != 0).select("x")
        found = components.interval_find(points, removed, by="g").collect()
        assert all(r.last == (r.x // step + 1) * step - 1 for r in found)
    word, bit = components.bit_place("x")
    assert points.select(word.alias("w"), bit.alias("b"), "x").where("w * 64 + b <> x").count() == 0


def test_order_statistics_by_place(spark):
    rows = spark.createDataFrame([(1, float(v)) for v in (5, 1, 3, 2, 4)] + [(2, 7.0)], "g long, v double")
    one, two = trials.trial_stats(rows, ["g"], "v").orderBy("g").collect()
    assert (one.min, one.lower, one.median, one.upper, one.max, one.mean) == (1, 2, 3, 4, 5, 3)
    assert one.rsd == pytest.approx(100 * 2**0.5 / 3) and (two.lower, two.upper, two.rsd) == (7, 7, 0)
    assert trials.trial_stats(rows.limit(0), ["g"], "v").collect() == []


def test_sweep_grid_runs_outwards(spark):
    grid = trials.sweep_grid(spark).orderBy("seq").collect()
    assert len(grid) == 400 and (grid[0].xfactor, grid[0].ffactor) == (3, 3)


def test_generators(spark):
    texts = {r.n: r.text for r in generate.fibonacci(spark, 6).collect()}
    assert texts == {0: "", 1: "a", 2: "ab", 3: "aba", 4: "abaab", 5: "abaababa", 6: "abaababaabaab"}
    assert [r.n for r in generate.fibonacci_source(spark, 3).orderBy("n").collect()] == [2, 3, 4]
    assert generate.growing_lengths(63) == [1, 2, 4, 7, 12, 21, 36, 62]
    row = spark.range(1).select(generate.periodic(6).alias("p"), generate.periodic(0).alias("z"), generate.random_text(9).alias("a"), generate.random_text(12).alias("b")).first()
    assert row.p == "acgtac" and row.z == "" and len(row.a) == 9 and row.b.startswith(row.a)
    found = generate.prefixes(spark.createDataFrame([(1, "abcdef"), (2, None), (3, "a")], "id long, t string"), "t", 5, ["id"]).orderBy("len").collect()
    assert [(r.id, r.prefix) for r in found] == [(1, "a"), (1, "ab"), (1, "abcd")]


FASTA = ">one x\nac gt\n;c\nAA\n>empty\n>two\n\tq\n>last\n"


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(FASTA)
    got = [(r.name, r.seq) for r in fasta.read(spark, str(tmp_path / "x.fa")).orderBy("record").collect()]
    assert got == [("one x", "acgtAA"), ("two", "\tq"), ("last", "")]
    lines = spark.createDataFrame([("x", k, v) for k, v in enumerate(FASTA.splitlines())], "file string, n long, value string")
    assert [(r.name, r.seq) for r in fasta.read_lines(spark, lines).orderBy("record").collect()] == got
    fasta.write(spark.createDataFrame([("n", "a" * 150)], "name string, seq string"), str(tmp_path / "out"))
    back = fasta.read(spark, str(tmp_path / "out")).where("name = 'n'").collect()
    assert [r.seq for r in back] == ["a" * 150]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        fasta.read(spark, str(tmp_path / "none.fa")).collect()


def test_measurement_tables(spark, tmp_path):
    rows = spark.createDataFrame([(0.3, 0.6, 1.5, 2.5, 0.1), (0.3, 0.9, 1.25, 2.0, 0.2)], measurements.LAYOUTS["sweep"])
    measurements.write(rows, str(tmp_path / "t"))
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("part-*"))
    assert text.splitlines()[0].split() == ["xfactor", "ffactor", "median_time", "mean_time", "RSD"]
    assert sorted(map(tuple, measurements.read(spark, str(tmp_path / "t"), "sweep").collect())) == sorted(map(tuple, rows.collect()))


def test_distances_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("kitten", "sitting"), (None, "a")], "a string, b string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a string, b string").parquet(str(tmp_path / "in"))
    query = with_distance(stream).writeStream.format("memory").queryName("distances").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.distance for r in spark.table("distances").where("a is not null").collect()) == [3]


def test_staged_runs(spark):
    from gramweave.functions.strings import plain_distance
    from gramweave.plans import staged

    pair = ("abaababaabaab" * 12, "abaababaabbab" * 11)
    at = pair
    for _, stage in staged.grammar_stages():
        at = stage(at)
    assert at == plain_distance(*pair)
    pairs = spark.createDataFrame([(1, *pair), (2, "abaab", "babaa")], "id long, a string, b string").selectExpr("*", "char_length(a) AS size")
    runs = staged.run(pairs, "grammar", staged.grammar_stages(), lambda row: (row["a"], row["b"]), ("id",), trials=3, outcome=int)
    stats = trials.trial_stats(runs, ["id", "engine", "size", "stage"], "seconds").collect()
    assert len(stats) == 6 and {r.stage for r in stats} == {"grammars", "tables", "grid"} and all(0 < r.min <= r.median <= r.max for r in stats)
    assert {(r.id, r.outcome) for r in runs.where("stage = 'grid'").collect()} == {(1, plain_distance(*pair)), (2, plain_distance("abaab", "babaa"))}
    perms = spark.createDataFrame([([2, 0, 1], [1, 0, 2], 3), ([0], [0], 1)], "p array<long>, q array<long>, size int")
    assert staged.run(perms, "product", staged.product_stages(), staged.product_of, trials=2).count() == 4
    for fast in (True, False):
        assert [r.outcome for r in staged.run(pairs.limit(1), "vector", staged.vector_stages(fast), staged.vector_of, trials=1, outcome=lambda v: v[-1]).collect()] == [3 * len(pair[0]) + 2 * len(pair[1])]
    assert staged.run(pairs, "build", staged.compression_stages(), lambda row: row["a"], trials=1).count() == 2
    swept = staged.sweep_factors(pairs, trials.sweep_grid(spark, step=3.0), trials=2).collect()
    assert len(swept) == 16 and {(r.a, r.distance) for r in swept} == {(a, plain_distance(a, b)) for a, b in (pair, ("abaab", "babaa"))}


def test_texts_and_grids_of_rows(spark):
    texts = {r.n: r.text for r in generate.fibonacci(spark, 12).collect()}
    rows = spark.range(13).select("id", generate.fibonacci_text(F.col("id")).alias("text"), generate.fibonacci_text(F.col("id"), "x", F.lit("y")).alias("other")).collect()
    assert all(r.text == texts[r.id] and r.other == texts[r.id].translate(str.maketrans("ab", "xy")) for r in rows)
    grid = [(r.xfactor, r.ffactor) for r in trials.sweep_grid(spark).orderBy("seq").collect()]
    rows = trials.sweep_grids(spark.range(2), "id", F.lit(3.0)).orderBy("seq").collect()
    assert all([(r.xfactor, r.ffactor) for r in rows if r.id == k] == grid for k in range(2))
    cells = tropical.filled_each(spark.range(3), "id", F.col("id"), F.lit(2), F.col("id") * 5).collect()
    assert sorted((r.id, r.i, r.j, r.v) for r in cells) == [(k, i, j, 5 * k) for k in range(3) for i in range(k) for j in range(2)]


def test_columns_of_any_name(spark):
    from gramweave.operators import distance

    rows = spark.createDataFrame([("ab", "b", 1, 2, 3, "k"), ("ab", "b", 4, 5, 6, "l"), (None, "x", 7, 8, 9, "m")], "a string, b string, _a int, _0 int, key int, value string")
    found = distance.distance(rows, engine="lcs", into="lcs")
    assert found.columns == [*rows.columns, "lcs"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("ab", "b", 1, 2, 3, "k", 1), ("ab", "b", 4, 5, 6, "l", 1), (None, "x", 7, 8, 9, "m", None)], key=str)


def test_files_are_split(spark, tmp_path):
    text = ";a comment\nlost\n>one\nac gt\n>two\n>three\nac\n;x\ngt\n>four\n"
    for k in range(3):
        (tmp_path / f"{k}.fa").write_text(text * (1 + 200 * k))
    rows = lambda df: sorted((r.file.rpartition("/")[2], r.record, r.name, r.seq) for r in df.collect())
    whole = rows(fasta.read(spark, str(tmp_path)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        assert rows(fasta.read_split(spark, str(tmp_path))) == whole and len(whole) > 1000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("plain, fan", [(10**6, 4096), (40, 8)])
@pytest.mark.parametrize("by", ["g", None])
def test_intervals_of_many_points(spark, monkeypatch, plain, fan, by):
    monkeypatch.setattr(components, "PLAIN", plain)
    monkeypatch.setattr(components, "FAN", fan)
    rnd = random.Random(plain)
    points = sorted((k % 2 if by else 0, x) for k, x in enumerate(rnd.sample(range(-200, 3000), 150)))
    removed = {x for _, x in points if rnd.random() < 0.9}
    found = components.interval_find(spark.createDataFrame(points, "g long, x long"), spark.createDataFrame([(x,) for x in removed], "x long"), by=by)
    want = {x: min((y for h, y in points if h == g and y >= x and y not in removed), default=None) for g, x in points}
    assert {r.x: r.last for r in found.collect()} == want
