import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gramweave.functions import grammar
from gramweave.operators import grammars

texts = st.text(alphabet="ab$é", max_size=40)


def fibonacci(n):
    a, b = "", "a"
    for k in range(n):
        a, b = b, ("ab" if k == 0 else b + a)
    return a


@given(texts)
@settings(max_examples=120, deadline=None)
def test_factors(s):
    factors = grammar.factorize(s)
    assert factors == grammar.factorize_automaton(s)
    at = 0
    for begin, end in factors:
        size = end - begin + 1
        assert (begin == at and size == 1 and s[at] not in s[:at]) or (end < at and s[begin : end + 1] == s[at : at + size] and s.find(s[at : at + size]) == begin)
        at += size
    assert at == len(s)


def test_golden_factors():
    assert grammar.factorize("abaababa") == [(0, 0), (1, 1), (0, 0), (0, 2), (1, 2)]
    assert grammar.factorize("aaaa") == [(0, 0), (0, 0), (0, 1)]
    assert [len(grammar.factorize(fibonacci(n))) for n in range(1, 16)] == list(range(1, 16))
    assert (len(fibonacci(14)), len(fibonacci(15))) == (610, 987)


@pytest.mark.parametrize("builder", grammar.BUILDERS)
@pytest.mark.parametrize("size", [0, 1, 2, 3, 10, 77, 500])
def test_builders_spell_their_text(builder, size):
    s = "".join(random.Random(size).choices("abc", k=size))
    g = grammar.BUILDERS[builder](s)
    assert g.text() == s and (g.root is None) == (not s)
    if builder == "balanced" and s:
        assert g.productions() == 2 * size - 1
    if builder == "compressed":
        assert all(abs(g.balance(k)) <= 1 for k in g.reached())
    if s:
        blown = grammar.blow_up(g)
        assert blown.spell() == [x for c in s for x in (c, grammar.SENTINEL)]
        if builder != "balanced":
            assert blown.productions() == g.productions() + len(set(s)) + 1


@given(texts, st.integers(1, 9))
@settings(max_examples=80, deadline=None)
def test_blocks_cover(s, x):
    g = grammar.compressed(s)
    spelt = ""
    for kind, nodes in grammar.blocks(g, x):
        text = "".join(c for k in nodes for c in g.spell(k))
        assert len(text) < 2 * x and (kind in ("left", "right") or len(text) >= x)
        spelt += text
    assert spelt == s


def test_compression_of_repetition():
    g = grammar.compressed(fibonacci(20))
    assert g.ratio() < 0.01 and g.productions() < 60
    assert grammar.block_length(0, 0) == 1 and grammar.block_length(10, 10_000) >= 1


def test_tables(spark):
    rows = spark.createDataFrame([(1, "abaababa"), (2, "a"), (3, None), (4, "")], "id long, t string")
    factors = grammars.factor_rows(rows, "t", ["id"]).where("id = 1").orderBy("seq").collect()
    assert [(f.begin, f.end) for f in factors] == [(0, 0), (1, 1), (0, 0), (0, 2), (1, 2)]
    spelt = grammars.derive(grammars.productions(rows, "t", ["id"]), ["id"]).collect()
    assert {r.id: r.text for r in spelt} == {1: "abaababa", 2: "a"}
    measured = {r.id: r for r in grammars.compression(rows, "t", ["id"]).collect()}
    assert measured[1].n_factors == 5 and measured[4].ratio is None and measured[4].n_productions == 0
    cut = grammars.partition(rows, "t", ["id"], x=2).orderBy("id", "pos").collect()
    assert "".join(r.content for r in cut if r.id == 1) == "abaababa"
    assert len({r.block_id for r in cut}) == len({r.content for r in cut})


def test_dot(spark):
    g = grammar.halved("abab")
    folded, unfolded = grammar.to_dot(g), grammar.to_dot(g, folded=False)
    assert folded.startswith("digraph") and folded.count("->") == 4 and unfolded.count("--") == 6
    rows = spark.createDataFrame([("ab",)], "t string")
    assert rows.select(grammars.dot("t").alias("d")).first().d.startswith("digraph")


def test_kinds_of_blocks():
    g = grammar.halved("abcdefgh")  # a full tree of eight
    assert [k for k, _ in grammar.blocks(g, 2)] == ["key"] * 4
    assert [k for k, _ in grammar.blocks(g, 9)] == ["left"]
    g = grammar.Grammar()
    a, b, c, d = (g.terminal(x) for x in "abcd")
    g.root = g.pair(g.pair(a, g.pair(b, c)), g.pair(d, g.pair(c, d)))  # a (bc) | d (cd): left of each key
    assert grammar.blocks(g, 2) == [("left", (a,)), ("key", (g.pair(b, c),)), ("left", (d,)), ("key", (g.pair(c, d),))]
    g.root = g.pair(g.pair(g.pair(a, b), c), g.pair(d, g.pair(c, d)))  # (ab) c | d (cd): one on the way up, one on the way down
    assert [k for k, _ in grammar.blocks(g, 2)] == ["key", "right", "left", "key"]


def test_long_texts_take_the_automaton(monkeypatch):
    monkeypatch.setattr(grammar, "LONG", 10)
    assert grammar.compressed("abracadabra" * 9).text() == "abracadabra" * 9
    monkeypatch.setattr(grammar, "factorize", None)
    assert grammar.compressed("abracadabra" * 9).text() == "abracadabra" * 9


def test_derivation_of_a_chain(spark):
    """A table as high as its text is long."""
    text = "abcabcab"
    rows = [(1, k, "T", c, None, None, 0, 1, False) for k, c in enumerate(sorted(set(text)))]
    ids, last, nodes = {c: k for k, c in enumerate(sorted(set(text)))}, None, len(set(text))
    for k, c in enumerate(text):
        if last is None:
            last = ids[c]
            continue
        rows.append((1, nodes, "N", None, last, ids[c], k, k + 1, k == len(text) - 1))
        last, nodes = nodes, nodes + 1
    table = spark.createDataFrame(rows, "id long, prod_id long, kind string, symbol string, left_id long, right_id long, height long, len long, is_root boolean")
    assert [r.text for r in grammars.derive(table, ["id"], fold=3).collect()] == [text]
