"""Nearest neighbours, near duplicates, fingerprints and secrets, against brute force."""

import hashlib
import random
import re
from collections import Counter

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramweave.llm import _graph, ann, fingerprints, jaccard_join, secret_scan

# nearest neighbours


def _brute(ids, x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]]
    return [(int(ids[i]), float(d[i])) for i in order[:k]]


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24))
    x[1000:2000] = x[1000]  # a third of all rows is one vector
    rows = [(k, v.tolist(), "extra", k) for k, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string, list int").repartition(5)
    found = {}
    for r in ann.neighbours(vectors, F.col("vec_id") % 50 == 0, shard_rows=300, query_rows=16).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids, hits = np.arange(3000), 0
    for q in range(0, 3000, 50):
        got, want = sorted(found[q]), _brute(ids, x, q, 10)
        assert [g[0] for g in got] == list(range(1, 11))
        assert all(g[2] == float(np.sqrt(((x[g[1]] - x[q]) ** 2).sum())) for g in got)
        if 1000 <= q < 2000:
            assert [g[1] for g in got] == [w[0] for w in want]
        hits += len({g[1] for g in got} & {w[0] for w in want})
    assert hits >= 0.9 * 600


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, []), (None, [1.0, 1.0]), (2, [3.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.neighbours(vectors, F.col("vec_id") % 100 == 0).collect())
    assert found == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (0, 4, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2), (100, 4, 2)]
    assert ann.neighbours(vectors.limit(0), F.lit(True)).collect() == []
    # lengths are tables of their own, whatever the first row has
    mixed = spark.createDataFrame([(0, [1.0]), (100, [3.0]), *((k, [float(k), 1.0]) for k in range(200, 260)), (300, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    found = {(r.query_id, r["rank"]): r.vec_id for r in ann.neighbours(mixed, F.col("vec_id") % 100 == 0).collect()}
    assert found[0, 1] == 100 and found[100, 1] == 0 and [found[200, k] for k in (1, 2, 3)] == [201, 202, 203] and (300, 1) not in found and len(found) == 12
    assert ann.neighbours(vectors.where("vec_id = 0"), F.lit(True)).collect() == []


@pytest.mark.parametrize("sample", [400, 20_000])
def test_recall_on_embeddings(spark, sample):
    """A small sample gives fewer centroids than the rows' root, so lists are pairs of centroids."""
    path = Path("/root/testdata/sf0.01/embeddings.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    vectors = spark.read.parquet(str(path))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.v for r in rows])
    found = {}
    for r in ann.neighbours(vectors, F.col("vec_id") % 100 == 0, sample=sample).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(found[int(ids[q])] & {i for i, _ in _brute(ids, x, q, 10)}) for q in np.flatnonzero(ids % 100 == 0))
    recall = hits / (10 * int((ids % 100 == 0).sum()))
    print(f"recall with a sample of {sample}: {recall:.3f}")
    assert recall >= 0.95


def test_lists_follow_the_rows():
    x = np.random.default_rng(1).normal(size=(800, 6))
    few, many = ann.fit(x, 800, k=5), ann.fit(x, 10**6, k=5)
    assert few.count == 28 and many.count == 1000 and len(many.base) == 100
    lists = many.lists(x)
    assert (np.abs(many.decoded(lists, many.codes(x, lists)) - x).max(1) < 2).mean() > 0.9
    table = many.tables(x[0], lists[:50])
    codes = many.codes(x[:50], lists[:50])
    summed = sum(table[np.arange(50), s, codes[:, s]] for s in range(table.shape[1]))
    assert np.allclose(summed, ((many.decoded(lists[:50], codes) - x[0]) ** 2).sum(1))


def test_shards_hold_their_rows():
    first, parts = ann.shards(np.array([5, 3, 2, 40, 1, 9]), 10)
    assert parts.tolist() == [1, 1, 1, 4, 1, 1] and first.tolist() == [0, 0, 0, 1, 5, 5]


# near duplicates


def _linked(rows, percent):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(table))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                up[root(a)] = root(b)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[root(k)] = min(names.get(root(k), i), i)
    return Counter((i, len(sets[k]), names.get(root(k))) for k, (i, _) in enumerate(rows))


def _texts(seed, n):
    rnd = random.Random(seed)
    words = ["a", "b", "C", "dd", "é", "f", "g", "h"]
    base = [" ".join(rnd.choices(words, k=rnd.randint(0, 40))) for _ in range(10)]
    rows = []
    for k in range(n):
        w = rnd.choice(base).split(" ")
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice([*words, f"z{k}"])
        rows.append((rnd.choice([None, *range(900)]), rnd.choice([None, "", " \t "]) if rnd.random() < 0.04 else " ".join(w)))
    return rows


@pytest.mark.parametrize(("classes", "shingles", "few", "common", "copies"), [(4096, 2_000_000, 256, 32, 10_000), (20, 10**7, 256, 2, 1), (4096, 300, 256, 5, 3), (4096, 10**7, 8, 32, 0)])
@pytest.mark.parametrize("percent", [80, 60])
def test_components_of_links(spark, monkeypatch, classes, shingles, few, common, copies, percent):
    for name, value in (("FEW", few), ("COMMON", common), ("COPIES", copies)):
        monkeypatch.setattr(jaccard_join, name, value)
    monkeypatch.setattr(jaccard_join, "CLASSES", classes)
    monkeypatch.setattr(jaccard_join, "SHINGLES", shingles)
    rows = _texts(percent, 300)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, id int, component_id string").repartition(4)
    assert Counter(map(tuple, jaccard_join.near_duplicates(docs, percent).collect())) == _linked(rows, percent)


def test_sets_of_one_id_are_told_apart(spark, monkeypatch):
    whole = jaccard_join._digest
    monkeypatch.setattr(jaccard_join, "_digest", lambda grams: bytes([len(grams) % 3]) * 8 + whole(grams)[8:])
    rows = _texts(7, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, jaccard_join.near_duplicates(docs, 80).collect())) == _linked(rows, 80)


def test_edge_of_the_threshold(spark):
    words = [f"w{k}" for k in range(49)]
    a, b = " ".join(words[:44]), " ".join([*words[:44], *words[44:49]])  # 40 and 45 shingles: 40 of 45
    c = " ".join([*words[:44], *[f"v{k}" for k in range(10)]])  # 40 of 50: 80 percent
    d = " ".join([*words[:44], *[f"u{k}" for k in range(11)]])  # 40 of 51
    docs = spark.createDataFrame([(4, a), (3, b), (2, c), (1, d)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()} == {4: 2, 3: 2, 2: 2, 1: 1}


def test_no_documents(spark):
    assert jaccard_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    lone = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.near_duplicates(lone).collect())) == [(1, 1, 1), (2, 0, 2)]


def test_merge_is_the_same_by_heap_and_by_sorting():
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.choice(500, 40, replace=False)) for _ in range(10)]
    small = [x[:3] for x in lists]
    for parts in (lists, small):
        ids, counts = jaccard_join._merged(parts)
        assert dict(zip(ids.tolist(), counts.tolist())) == Counter(np.concatenate(parts).tolist())


def test_graph_of_a_long_path(spark):
    edges = spark.range(60).select(F.pmod(F.col("id") * 37, F.lit(61)).alias("a"), F.pmod((F.col("id") + 1) * 37, F.lit(61)).alias("b"))
    assert {r.root for r in _graph.components(edges).collect()} == {0}
    assert _graph.components(edges.limit(0)).collect() == []


# fingerprints


def test_sketches_recover_the_difference():
    rnd = random.Random(1)
    words = ["aa", "bb.", "cc", "dd\n", "ee!", "ff", "De,", "de,", "gg" * 90]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 80))) for _ in range(200)] + ["", ""]
    a = [fingerprints._keys(t) for t in texts]
    b = [*a[1:], a[0]]
    third = fingerprints.sizes(a)
    other = np.roll(third, -1)
    want = [len(set(x.tolist()) ^ set(y.tolist())) for x, y in zip(a, b)]
    assert fingerprints.differing(a, b, np.maximum(third, other))[0].tolist() == want
    found, tries = fingerprints.differing(a, b, np.ones(len(a), np.int64))  # which must retry
    assert found.tolist() == want and tries.max() > 2
    assert fingerprints.likeness([a[-1]], [a[-2]], third[-1:], third[-2:-1]).tolist() == [1.0]
    assert all(len(set(k.tolist())) == len(k) for k in a)
    # what is written gives back all digests, and the likeness of any two
    shown = fingerprints.written(a, third)
    assert all(sorted(fingerprints.read(s)[0].tolist()) == sorted(k.tolist()) for s, k in zip(shown, a))
    jaccard = [len(set(x.tolist()) & set(y.tolist())) / max(1, len(set(x.tolist()) | set(y.tolist()))) for x, y in zip(a, b)]
    near = fingerprints.likeness(a, b, third, other)
    assert [fingerprints.likeness_of(x, y) for x, y in zip(shown, [*shown[1:], shown[0]])] == near.tolist()
    assert [1.0 if not len(x) + len(y) else j for x, y, j in zip(a, b, jaccard)] == pytest.approx(near.tolist())


def test_paragraphs_of_any_script():
    rng = np.random.default_rng(0)
    for low, high in ((0x4E00, 0x8E00), (0x410, 0x450), (97, 100)):
        near = []
        for _ in range(20):
            one, two = ("".join(map(chr, rng.integers(low, high, 4000).tolist())) for _ in range(2))
            assert "".join(fingerprints.paragraphs(one)) == one
            keys = [fingerprints._keys(one), fingerprints._keys(one[:2000] + two[:2000]), fingerprints._keys(one[:1000] + "new" + one[1000:])]
            shown = fingerprints.written(keys, fingerprints.sizes(keys))
            near.append(fingerprints.likeness_of(shown[0], shown[1]))
            assert fingerprints.likeness_of(shown[0], shown[2]) > 0.8  # an edit moves no cut but those near it
        assert sum(near) / 20 > 0.3 and min(near) > 0.15
    assert max(map(len, fingerprints.paragraphs("a" * 100_000))) <= fingerprints.MOST
    # order and separators count
    one = lambda t: fingerprints.written([k := fingerprints._keys(t)], fingerprints.sizes([k]))[0]
    for a, b in (("one.\ntwo.\nthree.\n", "three.\ntwo.\none.\n"), ("cats dogs", "cats\ndogs"), ("", " ")):
        assert one(a) != one(b) and one(a) == one(a) and fingerprints.likeness_of(one(a), one(b)) < 1


@pytest.mark.parametrize("range_rows", [1, 3, 1000])
def test_next_documents(spark, range_rows):
    rnd = random.Random(range_rows)
    rows = [(k * 3, " ".join(rnd.choices(["one.", "two", "日本", "x\n"], k=rnd.randint(0, 30)))) for k in range(40)] + [(1, None), (7, ""), (8, "y" * 20_000)]
    docs = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, range int, own string").repartition(5)
    found = sorted(fingerprints.compare_with_next(docs, range_rows).collect())
    rows = [(i, t or "") for i, t in sorted(rows)]
    assert len(found) == len(rows)
    for (i, t), (_, following), r, after in zip(rows, [*rows[1:], rows[0]], found, [*found[1:], found[0]]):
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(t), hashlib.sha256(edited.encode()).hexdigest())
        keys = [fingerprints._keys(edited)]
        assert r.edited_fingerprint == fingerprints.written(keys, fingerprints.sizes(keys))[0]
        # both likenesses come from the written fingerprints alone
        assert r.near_edited == fingerprints.likeness_of(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == fingerprints.likeness_of(r.fingerprint, after.fingerprint)
        if edited == t:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1


def test_sketches_of_documents_peel_at_first(spark):
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    texts = [r.text or "" for r in spark.read.parquet(str(path)).orderBy("doc_id").select("text").collect()]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, [*texts[1:], texts[0]])]
    a, b = ([fingerprints._keys(t) for t in side] for side in (texts, edited))
    third = np.maximum(fingerprints.sizes(a), fingerprints.sizes(b))
    assert (fingerprints.differing(a, b, third)[1] == 0).mean() >= 0.9


def test_an_id_of_many_rows_is_dealt(spark):
    rows = [(7, f"text {k} of one id") for k in range(300)] + [(None, f"none {k}") for k in range(90)] + [(k, "same") for k in range(9)] + [(3, "same")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = fingerprints.compare_with_next(docs, 16).collect()
    assert len(found) == len(rows)
    # by id (nulls first), then hash: each row's next is the next one, whatever range it is in
    ordered = [r.text for r in docs.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()]
    after = Counter()
    for t, n in zip(ordered, [*ordered[1:], ordered[0]]):
        after[hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()] += 1
    assert after == Counter(r.edited_sha256 for r in found)


def test_fingerprints_of_ties_and_nothing(spark):
    docs = spark.createDataFrame([(None, "a. b"), (1, None), (1, "x"), (1, "x"), (5, "c")], "doc_id long, text string")
    found = fingerprints.compare_with_next(docs, 1).collect()
    assert sorted(r.n_chars for r in found) == [0, 1, 1, 1, 4] and len({r.fingerprint for r in found}) == 4
    assert fingerprints.compare_with_next(docs.limit(0)).collect() == []
    assert [r.near_next for r in fingerprints.compare_with_next(docs.where("doc_id = 5")).collect()] == [1.0]


# secrets

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def _secret_rows():
    rnd = random.Random(4)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", ":", "=", " ", '"', "'", "abc", "abcdef", "AKIA", "ABCDEFGH12345678", "é", "日", "0123456789abcdef", "deadbeefdeadbeefdeadbeef", "-----BEGIN RSA PRIVATE KEY-----", "\n", "."]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(1, 14))) for _ in range(500)] + [None, "", "token: token: abcdefgh", "x" * 30_000 + " secret=hunter22"]
    return [(rnd.choice([None, -5, *range(40)]), t) for t in texts]


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_spans(spark, monkeypatch, limit):
    monkeypatch.setattr(secret_scan, "BROADCAST_BYTES", limit)
    rows = _secret_rows()
    docs = spark.createDataFrame([(*r, 1, "b", True) for r in rows], "doc_id long, text string, bucket int, spans string, c0 boolean").repartition(3)
    found = secret_scan.scan(docs).collect()
    got = Counter((r.doc_id, r.text, tuple((s.start, s.rule, s.end) for s in r.spans if s.rule < 3)) for r in found)
    assert got == Counter((i, t, tuple(_spans(t or ""))) for i, t in rows)
    shown = secret_scan.report(secret_scan.scan(docs)).collect()
    digest = lambda t: hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in _spans(t or "")).encode()).hexdigest()
    assert Counter((r.doc_id, r.base_sha256) for r in shown) == Counter((i, digest(t)) for i, t in rows)
    assert secret_scan.scan(docs.limit(0)).collect() == []


def _all_spans(text):
    more = ((3, "-----BEGIN [A-Z ]*PRIVATE KEY-----"), (4, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"), (5, "gh[opsu]_[A-Za-z0-9]{36,}"))
    return sorted([*_spans(text), *((m.start(), k, m.end()) for k, p in more for m in re.finditer(p, text))])


def test_all_kinds_from_files(spark, monkeypatch, tmp_path):
    """Rows of several files, in blocks of files; no text is moved."""
    rnd = random.Random(9)
    parts = ["-----BEGIN EC PRIVATE KEY-----", "eyJ", "abcdefgh1", "eyJabcdefgh1.abcdefgh1.x", "gho_" + "a1" * 18, "ghx_", ".", " ", "token=abcdef", "f" * 24]
    rows = [(k % 7, "".join(rnd.choices(parts, k=rnd.randint(0, 6)))) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    want = Counter((i, t, tuple(_all_spans(t))) for i, t in rows)
    for limit in (32 << 20, 30_000, 0):
        monkeypatch.setattr(secret_scan, "BROADCAST_BYTES", limit)
        found = secret_scan.scan(docs.withColumn("more", F.lit(1)))
        assert Counter((r.doc_id, r.text, tuple((s.start, s.rule, s.end) for s in r.spans)) for r in found.collect()) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan and "RoundRobin" not in plan
    assert plan.count("BroadcastHashJoin") >= 5


def test_names_of_kept_columns_are_free(spark):
    names = ["doc_id", "spans", "c0", "_place", "_bucket", "_file", "_text", "TEXT_", "text"]
    docs = spark.createDataFrame([(1, "s", 0, "p", 2, "f", "t", "u", "token=abcdef!"), (1, None, None, None, None, None, None, None, None)], "doc_id long, spans string, c0 int, _place string, _bucket int, _file string, _text string, TEXT_ string, text string")
    found = secret_scan.redact(docs)
    assert found.columns == names
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "s", 0, "p", 2, "f", "t", "u", "[SECRET]!"), (1, *[None] * 8)], key=str)
    assert secret_scan.scan(docs, keep=("doc_id", "spans", "c0")).columns == ["doc_id", "spans", "c0", "spans"]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(_secret_rows()[:5], "doc_id long, text string")
    assert not re.search("Python|Pandas|Arrow", secret_scan.report(secret_scan.scan(docs))._jdf.queryExecution().executedPlan().toString())


def test_queries_of_rules():
    assert secret_scan.trigram_query("[0-9a-f]{24,}") == secret_scan.ANY
    assert secret_scan.trigram_query("AKIA[A-Z0-9]{16,}") == frozenset([frozenset(["aki", "kia"])])
    assert secret_scan.trigram_query("(?:abc|xyz)d?") == frozenset([frozenset(["abc"]), frozenset(["xyz"])])
    assert secret_scan.trigram_query("a[bc]d.*") == frozenset([frozenset(["abd"]), frozenset(["acd"])])


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "a token = 'abcdef0123456789abcdef0123' b", 7), (2, None, 8), (3, "clean", 9)], "doc_id long, text string, extra int")
    assert sorted(map(tuple, secret_scan.redact(docs).collect()), key=str) == sorted([(1, "a [SECRET]' b", 7), (2, None, 8), (3, "clean", 9)], key=str)


def test_model_of_many_lists_is_small():
    """What tasks get grows with both kinds of centroids, not with the lists that they form."""
    import pickle

    rng = np.random.default_rng(3)
    model = ann.Model(rng.random((2500, 64)), rng.random((64, 64)), rng.random((16, 256, 4)), 1, 1)
    x = rng.random((3, 64))
    far = model.far(x)
    some = rng.integers(0, model.count, 500)
    assert model.count == 160_000 and np.allclose(far[:, some], ((x[:, None] - model.middles(some)) ** 2).sum(2))
    assert len(pickle.dumps(model)) < 8 << 20
