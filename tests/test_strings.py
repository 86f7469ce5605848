import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gramweave.functions import strings
from gramweave.operators import distance

texts = st.text(alphabet="ab*$é日", max_size=12)


def brute(a, b, wild=False):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            free = c == d or wild and "*" in (c, d)
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (not free)))
        row = new
    return row[-1]


def brute_lcs(a, b, wild=False):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b, 1):
            new.append(max(row[j], new[-1], row[j - 1] + (c == d or wild and "*" in (c, d))))
        row = new
    return row[-1]


@given(texts, texts)
@settings(max_examples=150, deadline=None)
def test_kernels_match_the_tables(a, b):
    assert strings.wildcard_distance(a, b) == brute(a, b, True)
    assert strings.subsequence_length(a, b) == brute_lcs(a, b, True)
    assert strings.subsequence_length(a, b, False) == brute_lcs(a, b)
    assert strings.blow_up_distance(a, b) == strings.plain_distance(a, b) == brute(a, b)
    assert list(strings.edit_rows(strings.codes(a), strings.codes(b), ord("*")))[-1][-1] == brute(a, b, True)
    assert strings.subsequence_grid(a, b)[-1][-1] == brute_lcs(a, b, True)


@given(texts, texts, texts)
@settings(max_examples=80, deadline=None)
def test_distance_is_a_metric(a, b, c):
    d = strings.blow_up_distance
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b)
    assert d(a, c) <= d(a, b) + d(b, c)
    assert abs(len(a) - len(b)) <= d(a, b) <= max(len(a), len(b))
    assert d(a, b) <= len(a) + len(b) - 2 * strings.subsequence_length(a, b, False)


def test_golden_cases():
    assert strings.wildcard_distance("a*c", "abc") == 0
    assert strings.blow_up_distance("$", "xy") == 2
    assert strings.blow_up_distance("kitten", "sitting") == 3
    assert strings.subsequence_length("", "abc") == 0


ROWS = [(1, "kitten", "sitting"), (2, "", "abc"), (3, None, "a"), (4, "ä", "a"), (5, "a*c", "abc"), (6, "$", "xy"), (7, "a", "a"), (8, "a", "a")]


def test_long_texts_as_rows_of_the_table():
    rng = np.random.default_rng(3)
    for n, m in ((700, 650), (64, 64), (65, 1), (1, 400), (2000, 300)):
        a, b = rng.integers(0, 4, n), rng.integers(0, 4, m)
        for wild in (None, 2):
            *_, row = strings.edit_rows(a, b, wild)
            *_, common = strings.subsequence_rows(a, b, wild)
            assert strings.bit_distance(a, b, wild) == row[-1] and strings.bit_subsequence(a, b, wild) == common[-1]


@pytest.mark.parametrize("engine", ["builtin", "long", "blow_up", "grammar", "grammar_direct"])
def test_engines_agree(spark, engine):
    pairs = spark.createDataFrame(ROWS, "id long, a string, b string")
    found = {r.id: r.distance for r in distance.distance(pairs, engine=engine).collect()}
    assert found == {1: 3, 2: 3, 3: None, 4: 1, 5: 1, 6: 2, 7: 0, 8: 0}
    long = spark.createDataFrame([("ab" * 300, "ba" * 250 + "é"), ("x", None)], "a string, b string")
    assert engine.startswith("grammar") or [r.distance for r in distance.distance(long, engine=engine).orderBy("a").collect()] == [brute("ab" * 300, "ba" * 250 + "é"), None]


def test_units_wildcards_and_null(spark):
    pairs = spark.createDataFrame(ROWS, "id long, a string, b string")
    by = lambda df: {r.id: r.distance for r in df.collect()}
    assert by(distance.distance(pairs, unit="bytes"))[4] == 2
    assert by(distance.distance(pairs, unit="bytes", engine="grammar"))[4] == 2
    assert by(distance.distance(pairs, wildcard=True))[5] == 0
    assert by(distance.distance(pairs, engine="indel")) == {1: 5, 2: 3, 3: None, 4: 2, 5: 2, 6: 3, 7: 0, 8: 0}
    with pytest.raises(ValueError):
        distance.distance(pairs, unit="words")


def test_threshold_nearest_and_blocks(spark):
    words = ["small ring", "small rang", "big ring", "bag ring", "tiny thing"]
    rows = spark.createDataFrame([(w, "k") for w in words], "w string, k string")
    pairs = rows.select(F.col("w").alias("a"), "k").join(rows.select(F.col("w").alias("b"), "k"), "k").where("a < b")
    want = {(a, b): brute(a, b) for a in words for b in words if a < b}
    near = {(r.a, r.b): r.distance for r in distance.within(pairs, 3).collect()}
    assert near == {k: v for k, v in want.items() if v <= 3}
    blocked = {(r.id_a, r.id_b): r.distance for r in distance.within_blocks(rows, F.col("k"), "w", "w", 3).distinct().collect()}
    assert blocked == near
    top = distance.nearest(pairs, ["a"], 1).collect()
    assert all(r.distance == min(v for (x, _), v in want.items() if x == r.a) for r in top)
    assert distance.within(pairs.limit(0), 3).collect() == []


def test_built_in_stays_in_the_jvm(spark):
    pairs = spark.createDataFrame(ROWS, "id long, a string, b string")
    plan = distance.distance(pairs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_native_subsequence(spark):
    rows = spark.createDataFrame([("abcab", "bacb"), ("", "a"), ("a", ""), ("aé日", "é日b")], "a string, b string")
    found = rows.select(strings.lcs_native(F.col("a"), F.col("b")).alias("n"), "a", "b").collect()
    assert all(r.n == brute_lcs(r.a, r.b) for r in found)


def test_grid_cells(spark):
    cells = distance.grid_cells(spark.createDataFrame([("ab", "b")], "a string, b string"), ["a"]).collect()
    assert {(c.i, c.j): c.v for c in cells} == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 0, (2, 0): 0, (2, 1): 1}


def test_rows_are_vectors():
    rows = list(strings.edit_rows(np.array([1, 2]), np.array([2])))
    assert [r.tolist() for r in rows] == [[0, 1], [1, 1], [2, 1]]
