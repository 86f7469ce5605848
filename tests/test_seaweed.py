import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramweave.functions import seaweed as S
from gramweave.operators import tables, tropical


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b, 1):
            new.append(max(row[j], new[-1], row[j - 1] + (c == d)))
        row = new
    return row[-1]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 13, 30, 61])
def test_product_by_its_definition(n, monkeypatch):
    rng = np.random.default_rng(n)
    for small in (1, 24):
        monkeypatch.setattr(S, "SMALL", small)
        for _ in range(8):
            p, q, r = (rng.permutation(n) for _ in range(3))
            want = S.density(S.min_plus(S.distribution(S.unfolded(p)), S.distribution(S.unfolded(q))))
            found = S.multiply(p, q)
            assert S.is_permutation(found) and (S.unfolded(found) == want).all()
            assert (S.multiply(S.multiply(p, q), r) == S.multiply(p, S.multiply(q, r))).all()
            assert (S.multiply(np.arange(n), p) == p).all() and (S.multiply(p, np.arange(n)) == p).all()


def test_algebra():
    rng = np.random.default_rng(1)
    p = rng.permutation(9)
    m = S.unfolded(p)
    assert (S.density(S.distribution(m)) == m).all()
    h = S.h_matrix(S.distribution(m), 4)
    assert (S.h_matrix(h, 4) == S.distribution(m)).all()
    t = S.Table(4, 5, p)
    assert (S.swapped(S.swapped(t)).perm == p).all() and (S.inverse(S.inverse(p)) == p).all()


def test_tables_merge_in_any_split_and_apply():
    rnd = random.Random(3)
    for _ in range(40):
        a, b = ("".join(rnd.choices("abc", k=rnd.randint(2, 8))) for _ in "ab")
        whole = S.table_of(a, b)
        i, j = rnd.randint(1, len(a) - 1), rnd.randint(1, len(b) - 1)
        assert (S.stacked(S.table_of(a[:i], b), S.table_of(a[i:], b)).perm == whole.perm).all()
        assert (S.beside(S.table_of(a, b[:j]), S.table_of(a, b[j:])).perm == whole.perm).all()
        m, n = len(a), len(b)
        out = S.applied(whole, np.zeros(m + n + 1, np.int64))
        assert out.tolist() == [lcs(a, b[:k]) if k <= n else lcs(a[: m - (k - n)], b) for k in range(m + n + 1)]
        vector = np.array(rnd.choices(range(-6, 6), k=m + n + 1))
        assert (S.vector_times_h(vector, whole) == S.vector_times_h_runs(vector, whole)).all()
        dense = S.distance_table_of(a, b)
        assert (S.distance_stacked(S.distance_table_of(a[:i], b), S.distance_table_of(a[i:], b), n) == dense).all()
        assert (S.distance_beside(S.distance_table_of(a, b[:j]), S.distance_table_of(a, b[j:]), m) == dense).all()


def _rows(spark, p):
    return spark.createDataFrame([(int(r), int(c)) for r, c in enumerate(p)], "r long, c long")


def test_relational_definition_is_the_kernel(spark):
    rng = np.random.default_rng(5)
    p, q = rng.permutation(7), rng.permutation(7)
    found = tropical.unit_monge_by_definition(_rows(spark, p), _rows(spark, q)).orderBy("r").collect()
    assert [r.c for r in found] == S.multiply(p, q).tolist()
    sigma = {(r.i, r.j): r.v for r in tropical.permutation_distribution(_rows(spark, p)).collect()}
    want = S.distribution(S.unfolded(p))
    assert sigma == {(i, j): want[i, j] for i in range(8) for j in range(8)}
    assert tropical.is_permutation(_rows(spark, p)).first().valid
    assert not tropical.is_permutation(_rows(spark, [0, 0])).first().valid
    swapped = {r.r: r.c for r in tropical.swap(_rows(spark, p)).collect()}
    assert [swapped[k] for k in range(7)] == S.swapped(S.Table(3, 4, p)).perm.tolist()


def test_products_of_sparse_matrices(spark):
    a = spark.createDataFrame([(0, 0, 1), (0, 1, 5), (1, 1, 2)], "i long, j long, v long")
    b = spark.createDataFrame([(0, 0, 7), (1, 0, 1)], "i long, j long, v long")
    as_dict = lambda df: {(r.i, r.j): r.v for r in df.collect()}
    assert as_dict(tropical.min_plus(a, b)) == {(0, 0): 6, (1, 0): 3}
    assert as_dict(tropical.max_plus(a, b)) == {(0, 0): 8, (1, 0): 3}
    assert tropical.min_plus(a.limit(0), b).collect() == []
    assert tropical.equal(a, a).first().equal and not tropical.equal(a, b).first().equal
    nested = spark.createDataFrame([([[1, 2], [3, 4]],)], "m array<array<long>>")
    assert as_dict(tropical.from_nested(nested, "m", [])) == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4}


def test_reduction_in_rounds(spark):
    a, b = "abcabcab", "cabb"
    chars = spark.createDataFrame([(1, k, c, b) for k, c in enumerate(a)] + [(2, 0, "x", b)], "g long, k long, c string, b string")
    found = tables.reduce_stack(chars.withColumn("table", tables.build("c", "b")), ["g"], "k")
    got = {r.g: list(r.table.perm) for r in found.collect()}
    assert got == {1: S.table_of(a, b).perm.tolist(), 2: S.table_of("x", b).perm.tolist()}


def test_single_cells(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b")], "a string, b string")
    perms = [list(r.t.perm) for r in rows.select(tables.cell(F.col("a"), F.col("b")).alias("t")).collect()]
    assert perms == [[0, 1], [1, 0]]


def test_products_of_monge_tables():
    rng = np.random.default_rng(12)
    for _ in range(60):
        n, inner, m = rng.integers(1, 30, 3)
        monge = lambda r, c: np.cumsum(np.cumsum(-rng.integers(0, 3, (r, c)), 0), 1) + rng.integers(0, 50, (r, 1)) + rng.integers(0, 50, (1, c))  # noqa: E731, B023
        a, b = monge(n, inner), monge(inner, m)
        assert (S.monge_min_plus(a, b) == S.min_plus(a, b)).all()


def test_distance_tables_of_any_cut():
    rng = random.Random(13)
    for _ in range(80):
        a, b = ["".join(rng.choice("ab") for _ in range(rng.randrange(2, 16))) for _ in range(2)]
        whole, i, j = S.distance_table_of(a, b), rng.randrange(1, len(a)), rng.randrange(1, len(b))
        assert (S.distance_stacked(S.distance_table_of(a[:i], b), S.distance_table_of(a[i:], b), len(b)) == whole).all()
        assert (S.distance_beside(S.distance_table_of(a, b[:j]), S.distance_table_of(a, b[j:]), len(a)) == whole).all()


@pytest.mark.parametrize(("name", "values"), [("COMBED", (4, 16, 200)), ("STEPPED", (0, 1 << 30)), ("SMALL", (1, 3)), ("DENSE", (0, 1 << 30)), ("COLUMNS", (1, 64))])
def test_sizes_that_choose_a_way_change_nothing(monkeypatch, name, values):
    rng = random.Random(15)
    cases = [tuple("".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))) for _ in range(2)) for _ in range(40)]
    perms = [(np.random.default_rng(k).permutation(n), np.random.default_rng(k + 99).permutation(n)) for k, n in enumerate((1, 2, 17, 40, 90))]
    half = lambda n: max(1, n // 2)

    def found():
        out = []
        for a, b in cases:
            t = S.table_of(a, b)
            out += [t.perm.tolist(), S.applied(t, np.zeros(t.rows + t.cols + 1, np.int64)).tolist()]
            if len(a) > 1:
                parts = S.h_of(S.table_of(a[: half(len(a))], b)), S.h_of(S.table_of(a[half(len(a)) :], b))
                out.append(S.h_stacked(*parts, len(b)).tolist())
        return out + [S.multiply(p, q).tolist() for p, q in perms]

    want = found()
    for value in values:
        monkeypatch.setattr(S, name, value)
        assert found() == want
