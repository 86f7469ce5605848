"""The registered queries over whole tables, against their SQL or brute force; and what operators make of repeated rows."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gramweave.llm import fingerprints, jaccard_join, packing, secret_scan, token_files, word_shuffle
from gramweave.llm.queries import ORACLES, QUERIES

P = pytest.importorskip("public_tokenizers")
DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def _table(name):
    return pq.read_table(DATA / f"{name}.parquet").to_pylist()


def _found(spark, name):
    return QUERIES[name](spark, str(DATA)).collect()


def _library(name):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path(name))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def _crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def _sha(data):
    return hashlib.sha256(data).hexdigest()


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want, found = con.sql(ORACLES[name]), QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in found.collect()) == Counter(tuple(r[k] for k in at) for r in want.fetchall())


@needs_data
def test_op1(spark):
    encode, at, want = _library("byte_bpe_50k.json"), 0, []
    for row in sorted(_table("documents"), key=lambda r: r["doc_id"]):
        ids = encode(row["text"])
        want.append((row["doc_id"], at, len(ids), _crc(ids)))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in _found(spark, "op1_token_files")) == want


@needs_data
def test_op2(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in _table("embeddings") if r["embedding"] and all(v is not None and np.isfinite(v) for v in r["embedding"]) and any(r["embedding"])]
    ids, x = np.array([k for k, _ in rows]), np.array([v for _, v in rows], np.float64)
    found, hits = defaultdict(list), 0
    for r in _found(spark, "op2_nearest_neighbours"):
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    asked = np.flatnonzero(ids % 100 == 0)
    assert set(found) == set(ids[asked].tolist())
    for q in asked:
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        own = sorted(found[int(ids[q])])
        best = [int(ids[k]) for k in np.lexsort((ids, far)) if ids[k] != ids[q]][:10]
        assert [n for n, _, _ in own] == list(range(1, len(best) + 1))
        assert all(score == far[int(np.flatnonzero(ids == k)[0])] for _, k, score in own) and own == sorted(own, key=lambda v: (v[2], v[1]))
        hits += len({k for _, k, _ in own} & set(best))
    assert hits >= 0.9 * 10 * len(asked)


@needs_data
def test_op3_and_op4(spark):
    docs = _table("documents")
    scored = _found(spark, "op3_quality_classifier")
    assert Counter(r.doc_id for r in scored) == Counter(r["doc_id"] for r in docs) and all(0 <= r.score <= 1 for r in scored)
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in docs}
    known = {r["lang"] for r in docs if r["lang"] is not None and not held[r["doc_id"]]}
    letters = {r["doc_id"]: bool(re.search(r"[^\W\d_]", r["text"] or "")) for r in docs}
    found = _found(spark, "op4_language_id")
    assert Counter((r.doc_id, r.held_out) for r in found) == Counter(held.items())
    assert all(0 <= r.score <= 1 and (r.lang_pred in known if letters[r.doc_id] else r.lang_pred == "und") for r in found)


@needs_data
def test_op5(spark):
    encode = word_shuffle.encoding(P.path("byte_bpe_50k.tiktoken")).encode_ordinary
    want = Counter()
    for r in _table("documents"):
        ids = encode(r["text"] or "")
        want[r["doc_id"], len(ids), _sha(" ".join(map(str, ids)).encode()), _sha((r["text"] or "").encode())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in _found(spark, "op5_word_shuffle")) == want


@needs_data
def test_op6(spark):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in _table("documents")))
    found = {r.doc_id: r for r in _found(spark, "op6_fingerprints")}
    assert len(found) == len(docs)
    for k, (doc_id, text) in enumerate(docs):
        after_id, after = docs[(k + 1) % len(docs)]
        row, half = found[doc_id], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (row.n_chars, row.edited_sha256) == (len(text), _sha(edited.encode()))
        # the likenesses are those of the written fingerprints
        assert row.near_edited == fingerprints.likeness_of(row.fingerprint, row.edited_fingerprint)
        assert row.near_next == fingerprints.likeness_of(row.fingerprint, found[after_id].fingerprint)
        assert (row.fingerprint == row.edited_fingerprint) == (text == edited)


@needs_data
def test_op7(spark):
    encode, want = _library("word_bpe_49k.json"), Counter()
    for r in _table("documents"):
        ids = encode(r["text"])
        for piece, at in enumerate(range(0, len(ids), 2048)):
            want[r["doc_id"], piece, at, len(ids[at : at + 2048]), _crc(ids[at : at + 2048])] += 1
    found = _found(spark, "op7_best_fit_packing")
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    assert sorted(ends_of(sequences)) == sorted(packed_one_by_one([n for _, _, _, n, _ in want.elements()], 2048))


def ends_of(sequences):
    return [sum(n for _, n in parts) for parts in sequences.values()]


def packed_one_by_one(lengths, capacity):
    """What each bin holds: the longest large item with the longest that fits, then each smaller one, longest first, in the fullest bin that takes it."""
    large, loads = sorted(n for n in lengths if 3 * n > capacity), []
    while large:
        longest = large.pop()
        partner = max((n for n in large if longest + n <= capacity), default=0)
        if partner:
            large.remove(partner)
        loads.append(longest + partner)
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [load for load in loads if load + n <= capacity]
        if fits:
            loads.remove(max(fits))
        loads.append(max(fits, default=0) + n)
    return loads


@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
@settings(max_examples=200, deadline=None)
def test_the_plan_packs_as_one_by_one(case):
    capacity, lengths = case
    plan = packing.plan_bins(Counter(lengths), capacity)
    assert sorted(sum(n * k for n, k in items) for items, bins in plan for _ in range(bins)) == sorted(packed_one_by_one(lengths, capacity))


@needs_data
def test_op8(spark):
    pages = _table("pages")
    found = {r.page_id: r for r in _found(spark, "op8_html_extraction")}
    assert {k: r.url for k, r in found.items()} == {r["page_id"]: r["url"] for r in pages}
    assert all(r.n_chars == len(r.text) and r.text == "\n".join(" ".join(line.split()) for line in r.text.split("\n")) for r in found.values())


@needs_data
def test_op10_by_python(spark):
    want = {}
    for r in _table("documents"):
        spans = []
        for number, rule in enumerate(secret_scan.RULES):
            spans += [(m.start(), number, m.end()) for m in re.finditer(rule.pattern, r["text"] or "") if len(m[rule.group]) >= rule.least]
        want[r["doc_id"]] = ",".join(f"{secret_scan.RULES[n].kind}:{a}:{b}" for a, n, b in sorted(spans))
    assert {r.doc_id: r.spans for r in _found(spark, "op10_secret_scans")} == want


TEXTS = ["one two three four five six seven\npassword = hunter22", None, "x", "one two three four five six seven\npassword = hunter22 eyJabcdefgh.ijklmnopq.rst " + "q" * 30]
REPEATED = {"one doc_id": [(7, t) for t in TEXTS * 60], "no doc_id": [(None, t) for t in TEXTS * 60]}


@pytest.mark.parametrize("kind", sorted(REPEATED))
def test_rows_of_one_doc_id(spark, tmp_path, kind):
    """Rows of one doc_id, or of none, are documents of their own in every operator."""
    rows = REPEATED[kind]
    name, n = rows[0][0], len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = Counter(t or "" for _, t in rows)
    byte, word = _library("byte_bpe_50k.json"), _library("word_bpe_49k.json")

    path = token_files.write_token_files(docs, str(tmp_path / "t"), P.path("byte_bpe_50k.json"))
    found = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert Counter(r.ids_crc32 for r in found) == Counter(_crc(byte(t)) for t in texts.elements()) and [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found[:-1])]).tolist() and {r.doc_id for r in found} == {name}

    found = word_shuffle.encode_and_decode(docs, P.path("byte_bpe_50k.tiktoken")).collect()
    assert Counter(bytes(r.decoded).decode() for r in found) == texts and {r.doc_id for r in found} == {name}

    found = fingerprints.compare_with_next(docs, range_rows=50).collect()
    assert Counter(r.n_chars for r in found) == Counter(len(t) for t in texts.elements()) and all(0 <= r.near_next <= 1 for r in found)

    found = packing.pack(docs, P.path("word_bpe_49k.json"), capacity=64).collect()
    assert Counter(r.ids_crc32 for r in found) == Counter(_crc(word(t)[a : a + 64]) for t in texts.elements() for a in range(0, len(word(t)), 64))

    found = jaccard_join.near_duplicates(docs).collect()
    assert len(found) == n and {r.component_id for r in found} == {name}

    found = secret_scan.report(secret_scan.scan(docs)).collect()
    assert Counter(r.spans for r in found) == Counter({"": 120, "assign:34:53": 60, "assign:34:53,jwt:54:79": 60})


@pytest.mark.parametrize("ids", [(7,), (None,)])
def test_vectors_of_one_id(spark, ids):
    from gramweave.llm import ann

    rows = [(ids[0], [float(k % 3), 1.0]) for k in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ann.neighbours(vectors, F.lit(True)).collect() == []  # no candidates but those of the query's own id


def test_written_tables_are_cleared(spark):
    from gramweave.llm import _base

    rows = spark.range(3)
    with _base.cleared():
        inner = _base.stash(rows, "a")
        assert inner.count() == 3
    files = spark._jvm.org.apache.hadoop.fs.Path(inner.stash_path)
    assert not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)
    assert _base.stash(rows, "b").count() == 3 and not _base._open
