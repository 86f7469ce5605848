"""Token files, packing, and the distinct-word shuffle, against the tokenizer libraries."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from gramweave.llm import packing, token_files, word_shuffle
from gramweave.llm.tokenizer_units import UnitEncoder

P = pytest.importorskip("public_tokenizers")

#: Nulls, empties, ties, repeats, white space of all sorts, other scripts, marks, a very long text.
ROWS = [(5, "The cat, the dog. It's 42!"), (3, None), (3, ""), (3, "  a  b \n c\t"), (3, "same"), (3, "same"), (None, "no id"), (9, "日本 Ünïcödé Σίσυφος <|endoftext|> \x1c x"), (1, "tail \n \n "), (2, "word " * 3000), (8, "x" * 5000), (4, "end <|endoftext|> start"), (4, "<|StartOfText|><|startoftext|>x <|endoftext|"), (4, "a <| b")]
SCHEMA = "doc_id long, text string"
CLASHING = "doc_id long, text string, part int, segment int, n_tokens string, chunk string, length double, nth long, _row int, h string"


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    out = {}
    for words, name in ((False, "byte_bpe_50k.json"), (True, "word_bpe_49k.json")):
        out[words] = Tokenizer.from_file(P.path(name))
    return out


@pytest.fixture(scope="module")
def encoders():
    return {False: UnitEncoder(P.path("byte_bpe_50k.json"), False, most=50), True: UnitEncoder(P.path("word_bpe_49k.json"), True, most=50)}


@given(st.text(alphabet="ab  \n\t'sTé1²,.! Ñß-_ \r\x1c\x85ć日ΣİǰJ̌", max_size=25) | st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", " ", "a", " it's"]), max_size=8).map("".join))
@settings(max_examples=300, deadline=None)
def test_units_encode_as_the_library(libraries, encoders, text):
    for words in (False, True):
        own = np.frombuffer(encoders[words].encode(text), encoders[words].dtype).tolist()
        assert own == libraries[words].encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 60), min_size=1, max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano_boundaries(sizes):
    names = [None, None, *(3 * k - 100 if k % 3 else -(2**63) for k in range(len(sizes)))][: len(sizes)]
    names.sort(key=lambda x: (x is not None, x))
    record = token_files.pack_segment(names, [np.full(n, k, "<u2").tobytes() for k, n in enumerate(sizes)], 2)
    seg = token_files.Segment(record)
    ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    assert seg.bounds().tolist() == ends and [seg.ends.select(i) for i in range(len(ends))] == ends
    assert seg.doc_ids() == names and all(names.index(x) in seg.find(x) and names.count(x) == len(seg.find(x)) for x in set(names) - {None}) and not seg.find(10**9)
    assert all((seg.document(i) == i).all() and len(seg.document(i)) == n for i, n in enumerate(sizes))
    bits = 8 * (len(seg.ends.high) + len(seg.ends.low))
    assert bits <= (2 + max(0, np.log2(max(1, sum(sizes)) / len(sizes)) + 1)) * (len(sizes) + 1) + 40


def test_not_a_record():
    with pytest.raises(ValueError):
        token_files.Segment(b"nope" + b"\0" * 60)


def _written(spark, rows, tmp_path, libraries, schema=SCHEMA):
    docs = spark.createDataFrame([(*r, *[None] * (schema.count(",") - 1)) for r in rows], schema)
    path = token_files.write_token_files(docs, str(tmp_path / "t"), P.path("byte_bpe_50k.json"), most_ids=500)
    return sorted(token_files.read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r.start)


@pytest.mark.parametrize("schema", [SCHEMA, CLASHING])
def test_token_files(spark, tmp_path, libraries, schema):
    found = _written(spark, ROWS, tmp_path, libraries, schema)
    assert [r.doc_id for r in found] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i))
    want = Counter()
    for doc_id, text in ROWS:
        want[doc_id, tuple(libraries[False].encode(text or "", add_special_tokens=False).ids + [0])] += 1
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == want
    at = 0
    for r in found:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids))
        at += r.n_tokens


def test_fetched_documents(spark, tmp_path, libraries):
    found = _written(spark, ROWS, tmp_path, libraries)
    for asked in ([3, 9, 77], [2], []):
        rows = token_files.fetch(spark, str(tmp_path / "t"), asked).collect()
        assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == Counter((r.doc_id, tuple(r.ids)) for r in found if r.doc_id in asked)


def test_token_files_of_nothing(spark, tmp_path, libraries):
    assert _written(spark, [], tmp_path, libraries) == []


@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
@settings(max_examples=200, deadline=None)
def test_bins(case):
    capacity, lengths = case
    plan = packing.plan_bins(Counter(lengths), capacity)
    held = Counter()
    for items, bins in plan:
        assert bins > 0 and sum(n * k for n, k in items) <= capacity
        for n, k in items:
            held[n] += k * bins
    assert held == Counter(lengths)
    total = sum(bins for _, bins in plan)
    assert total >= -(-sum(lengths) // capacity)
    large = [n for n in lengths if 3 * n > capacity]
    assert total <= max(len(large), 1) + 2 * sum(lengths) // capacity + 1


def test_bins_of_many_pieces_are_few_patterns():
    rng = np.random.default_rng(0)
    counts = Counter(rng.integers(1, 2049, 400_000).tolist())
    plan = packing.plan_bins(counts, 2048)
    assert len(plan) < 20_000 and sum(b for _, b in plan) < 1.06 * sum(n * c for n, c in counts.items()) / 2048


@pytest.mark.parametrize("schema", [SCHEMA, CLASHING])
def test_packing(spark, libraries, schema):
    docs = spark.createDataFrame([(*r, *[None] * (schema.count(",") - 1)) for r in ROWS], schema).repartition(3)
    found = packing.pack(docs, P.path("word_bpe_49k.json"), capacity=64).collect()
    want = Counter()
    for doc_id, text in ROWS:
        ids = libraries[True].encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 64)):
            cut = ids[at : at + 64]
            want[doc_id, piece, at, len(cut), zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))] += 1
    assert Counter(tuple(r)[:5] for r in found) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(docs.limit(0), P.path("word_bpe_49k.json")).collect() == []


@pytest.mark.parametrize("schema", [SCHEMA, CLASHING])
@pytest.mark.parametrize("chunk", [40, 1_000_000])
def test_word_shuffle(spark, tmp_path, schema, chunk):
    encoding = word_shuffle.encoding(P.path("byte_bpe_50k.tiktoken"))
    spark.createDataFrame([(*r, *[None] * (schema.count(",") - 1)) for r in ROWS], schema).repartition(2).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    want = Counter()
    for doc_id, text in ROWS:
        ids = encoding.encode_ordinary(text or "")
        want[doc_id, len(ids), " ".join(map(str, ids)), (text or "").encode()] += 1
    found = word_shuffle.encode_and_decode(docs, P.path("byte_bpe_50k.tiktoken"), chunk_chars=chunk).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids, bytes(r.decoded)) for r in found) == want
    digests = word_shuffle.encode_and_decode(docs, P.path("byte_bpe_50k.tiktoken"), digests=True, chunk_chars=chunk).collect()
    assert Counter(r.ids for r in digests) == Counter(hashlib.sha256(k[2].encode()).hexdigest() for k in want.elements())
    assert word_shuffle.encode_and_decode(docs.limit(0), P.path("byte_bpe_50k.tiktoken")).collect() == []


def test_cuts_are_the_library_s():
    """Every character that is in use counts as the letter, number, mark or blank that it is to the library: the
    library encodes two characters to one token only if they are one cut."""
    import tiktoken
    import unicodedata

    chars = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Co", "Cs") and not 0x3400 < ord(c) < 0x9FFF and not 0xAC00 < ord(c) < 0xD7A3 and not 0x17000 < ord(c) < 0x18CD5 and not 0x20000 < ord(c) < 0x323AF]
    assert len(chars) > 30_000 and all(map(word_shuffle.is_cut_alike, chars))
    pairs = [p + c for c in chars for p in "a1!"]
    ranks = {bytes([b]): b for b in range(256)}
    for pair in pairs:
        ranks.setdefault(pair.encode(), len(ranks))
    library = tiktoken.Encoding("pairs", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    find = regex.compile(P.PATTERN).findall
    assert [p for p in pairs if (len(library.encode_ordinary(p)) == 1) != (len(find(p)) == 1)] == []
    assert not word_shuffle.is_cut_alike(chr(0x10FFFF)) and not word_shuffle.is_cut_alike("a" + chr(0x378))


#: Text in many scripts, whose words occur in many documents.
SCRIPTS = "Съешь ещё этих мягких французских булок, да выпей чаю. Η ταχεία αλώπηξ πηδάει. نص حكيم له سر قاطع 我能吞下玻璃而不伤身体。 いろはにほへと 123 ٣٤ 🎉🎉 c'est déjà l'été\u2028 \u3000 x"


def test_words_of_all_scripts_are_shuffled(spark, tmp_path):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices(SCRIPTS.split(" "), k=rnd.randrange(40))) for _ in range(60)] + ["x\U0010ffff 我能 y"]
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(2).write.parquet(str(tmp_path / "docs"))
    encoding = word_shuffle.encoding(P.path("byte_bpe_50k.tiktoken"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    want = {k: (" ".join(map(str, encoding.encode_ordinary(t))), t.encode()) for k, t in enumerate(texts)}
    for source in (docs, docs.repartition(3, "text")):  # straight from files, or written first
        found = word_shuffle.encode_and_decode(source, P.path("byte_bpe_50k.tiktoken"), chunk_chars=900).collect()
        assert {r.doc_id: (r.ids, bytes(r.decoded)) for r in found} == want
    assert word_shuffle._reads_alike(docs.select("text").where("doc_id > 3")) and not word_shuffle._reads_alike(docs.repartition(3))


def test_decode(spark):
    rows = spark.createDataFrame([(1, [15496, 995]), (2, []), (3, None)], "k long, ids array<long>")
    found = {r.k: r.decoded for r in word_shuffle.decode(rows, P.path("byte_bpe_50k.tiktoken")).collect()}
    assert bytes(found[1]) == b"Hello world" and bytes(found[2]) == b"" and found[3] is None
