"""Secret scanning through a trigram inverted index, in DataFrame functions only.

Each rule's regex is parsed and a Boolean trigram query derived from it: any text that matches must
hold all trigrams of one of its alternatives. The corpus is indexed once for the trigrams that the
rules ask for (postings: one bitmap of 32,768 rows of a file a trigram); a query is the AND of
its trigrams' bitmaps, then the OR of its alternatives. Only candidates meet the regex. Rules whose
regex has no mandatory trigram (`hex`) scan every text.

A row's place is its file and its number in it, which any reading of the table gives again, so postings are summed where
they are read and no document is moved: bitmaps that are too many for one broadcast go out in blocks of files, each with the
scan of those files. A table that is not read from Parquet files is written first. Rows that share a place (of a
table that repeats its files' rows), and letters, which are
indexed in lower case, may let a text pass for nothing; the regex decides.

Defined cases: null or empty text has no span; doc_id plays no part, so rows of equal or null doc_id
are verified one by one; spans are in code points, end exclusive; an empty table gives no row; kept columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as C
from re import _parser as parser

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramweave.operators.spread import spread

from ._base import column, numbered, stash


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Matches stay whose group has so many characters.
    group: int
    least: int


#: Base rules (fixed values), then those that this operator adds. `hex` and `access` ask for their
#: least length in the pattern: their runs are maximal, so the same matches stay.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}", 0, 1),
)
BASE = 3
#: Documents of one bitmap: what the bitmap functions hold in 4 KB.
BITS = 32_768
#: Bytes of candidate bitmaps that are broadcast at once; of more, blocks of files are.
BROADCAST_BYTES = 32 << 20
#: Strings that a part of a regex is expanded to at most, before its trigrams are taken.
EXPAND = 64

Alternatives = frozenset[frozenset[str]]
ANY: Alternatives = frozenset([frozenset()])


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[k : k + 3] for k in range(len(text) - 2))


def _both(a: Alternatives, b: Alternatives) -> Alternatives:
    return _least(frozenset(x | y for x in a for y in b))


def _least(a: Alternatives) -> Alternatives:
    """Without alternatives that ask for more than another one does."""
    return frozenset(x for x in a if not any(y < x for y in a))


def _of(strings: frozenset[str]) -> Alternatives:
    return _least(frozenset(_trigrams(s) for s in strings)) if strings else ANY


def _class(items: list) -> frozenset[str] | None:
    """The characters of a class if they are few, in lower case."""
    if items[0][0] is C.NEGATE:
        return None
    spans = [(v, v) if op is C.LITERAL else v if op is C.RANGE else None for op, v in items]
    if None in spans or sum(b - a + 1 for a, b in spans) > 8:
        return None
    return frozenset(chr(c).lower() for a, b in spans for c in range(a, b + 1))


def _parse(tokens) -> tuple[frozenset[str] | None, Alternatives]:
    """All strings that a part of a regex can be, if few, and what any match of it must hold."""
    run: frozenset[str] = frozenset([""])
    whole, query = True, ANY

    def cut() -> None:
        nonlocal run, whole, query
        query, run, whole = _both(query, _of(run)), frozenset([""]), False

    for op, value in tokens:
        exact, inner = None, ANY
        if op is C.LITERAL:
            exact = frozenset([chr(value).lower()])
        elif op is C.IN:
            exact = _class(value)
        elif op is C.SUBPATTERN:
            exact, inner = _parse(value[3])
        elif op is C.BRANCH:
            parts = [_parse(x) for x in value[1]]
            if all(e is not None for e, _ in parts):
                exact = frozenset().union(*(e for e, _ in parts))
            inner = _least(frozenset().union(*(_of(e) if e is not None else q for e, q in parts)))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = value
            found, need = _parse(body)
            if found is not None and high == 1:
                exact = found | {""} if low == 0 else found
            elif low:
                inner = need if found is None else _of(found)
                if found is not None and len(found) == 1 and low < 16:  # a string that is repeated
                    inner = _of(frozenset([next(iter(found)) * low]))
        elif op is C.AT:
            continue
        if exact is not None and len(run) * len(exact) <= EXPAND:
            run = frozenset(a + b for a, b in product(run, exact))
        else:
            cut()
            query = _both(query, inner if exact is None else _of(exact))
    if whole:
        return run, _of(run)
    cut()
    return None, query


def trigram_query(pattern: str) -> Alternatives:
    """Alternatives of trigrams, all of one of which are in any text that matches; one that is empty: no demand."""
    return _parse(parser.parse(pattern))[1]


def _placed(docs: DataFrame, text: str) -> DataFrame:
    """The columns with numbers for names, the text with null as the empty one, and each row's place: file, chunk and bit."""
    places = ("_file", "_row")
    try:
        own = docs.metadataColumn("_metadata")
        rows = docs.select("*", F.xxhash64(own["file_path"]), own["row_index"])
    except AnalysisException:  # not rows of Parquet files
        own = (docs := stash(numbered(docs), "texts")).metadataColumn("_metadata")
        rows = docs.select("*", F.xxhash64(own["file_path"]), own["row_index"])
    rows = rows.toDF(*[f"_{k}" for k in range(len(docs.columns))], *places)
    row = F.col("_row")
    return rows.select("*", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), F.floor(row / BITS).alias("_chunk"), (row % BITS).alias("_bit")).drop("_row")


def _candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(_file, _chunk, c0, c1, ...): which rows of a chunk may match each indexed rule, as bitmaps."""
    spark = rows.sparkSession
    asked = [(no, alt, trigram, len(trigrams)) for no, rule in enumerate(rules) if (q := trigram_query(rule.pattern)) != ANY for alt, trigrams in enumerate(sorted(map(sorted, q))) for trigram in trigrams]
    vocabulary = sorted({x[2] for x in asked})
    lowered = rows.select("_file", "_chunk", "_bit", F.lower("_text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(n)) for n, t in enumerate(vocabulary)]))
    posts = lowered.select("_file", "_chunk", "_bit", F.explode(held).alias("trigram"))
    index = posts.groupBy("_file", "_chunk", "trigram").agg(F.bitmap_construct_agg("_bit").alias("docs"))
    terms = spark.createDataFrame([(no, alt, vocabulary.index(t), n) for no, alt, t, n in asked], "rule int, alt int, trigram int, n int")
    matched = index.join(F.broadcast(terms), "trigram").groupBy("_file", "_chunk", "rule", "alt", "n").agg(F.bitmap_and_agg("docs").alias("docs"), F.count(F.lit(1)).alias("found"))
    alternatives = matched.where("found = n")
    columns = [F.bitmap_or_agg(F.when(F.col("rule") == no, F.col("docs"))).alias(f"c{no}") for no in sorted({x[0] for x in asked})]
    return alternatives.groupBy("_file", "_chunk").agg(*columns)


def _bit(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) > 0, F.lit(False))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """[(start, number, end)] of the matches that stay: gaps and matches alternate, so lengths add up to places."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), matches.alias("hit"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"))
    empty = F.array().cast("array<struct<start:int,rule:int,end:int>>")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.char_length(part["gap"])
        end = start + F.coalesce(F.char_length(part["hit"]), F.lit(0))
        stays = part["hit"].isNotNull() & (F.char_length(part["value"]) >= rule.least)
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("rule"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(stays, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    scan = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda s: s["spans"])
    return F.when(F.size(matches) > 0, scan).otherwise(empty)


def _scanned(docs: DataFrame, rules: tuple[Rule, ...], text: str) -> DataFrame:
    """The columns with numbers for names, and `_spans`."""
    rows = _placed(docs, column(docs, text))
    found = stash(_candidates(rows, rules), "candidates")
    flags = [c for c in found.columns if c[0] == "c"]
    # the check of the broadcast's size: rows counted, 4 KB a bitmap
    blocks = max(1, -(-found.count() * len(flags) * BITS // 8 // max(1, BROADCAST_BYTES)))
    blocks = min(blocks, max(1, found.select("_file").distinct().count())) if blocks > 1 else 1
    file, chunk = (found[c].alias(f"_of{c}") for c in ("_file", "_chunk"))
    kept = found.select(file, chunk, *flags)
    marked = []
    for k in range(blocks):
        own = lambda df, c: df.where(F.pmod(F.col(c), F.lit(blocks)) == k) if blocks > 1 else df  # noqa: E731, B023
        part = own(rows, "_file").join(F.broadcast(own(kept, "_of_file")), (F.col("_file") == F.col("_of_file")) & (F.col("_chunk") == F.col("_of_chunk")), "left")
        marked.append(part.withColumns({c: _bit(F.col(c), F.col("_bit")) for c in flags}))
    empty = F.array().cast("array<struct<start:int,rule:int,end:int>>")
    spans = []
    for number, rule in enumerate(rules):
        possible = F.col(f"c{number}") if f"c{number}" in flags else F.col("_text").rlike(rule.pattern)
        spans.append(F.when(possible, _spans(F.col("_text"), rule, number)).otherwise(empty))
    return reduce(DataFrame.unionAll, marked).select(*[f"_{k}" for k in range(len(docs.columns))], F.array_sort(F.concat(*spans)).alias("_spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id", "text"), text: str = "text", into: str = "spans") -> DataFrame:
    """The kept columns of each row and `into`: [(start, rule, end)] of all rules by start, then rule."""
    return _scanned(docs, rules, text).select(*[column(docs, c) for c in keep], "_spans").toDF(*keep, into)


def _shown(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The same rows and columns, every span of the text replaced by a mark (overlapping spans by one)."""
    at = column(docs, text)
    own = F.col(at).cast("string")
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        begins = span["start"] + 1 >= state["at"]
        gap = F.substring(own, state["at"], F.greatest(span["start"] + 1 - state["at"], F.lit(0)))
        return F.struct(F.greatest(state["at"], span["end"] + 1).alias("at"), F.when(begins, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(own, s["at"], F.char_length(own)))
    clean = F.when(F.size("_spans") > 0, F.aggregate("_spans", start, step, rest)).otherwise(own)
    names = [f"_{k}" for k in range(len(docs.columns))]
    return _scanned(docs, rules, text).select(*[clean.alias(c) if c == at else F.col(c) for c in names]).toDF(*docs.columns)


def _is_rule(number: int):
    return lambda span: span["rule"] == number


def report(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, digest of the base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["rule"] < BASE)
    counts = [F.size(F.filter("spans", _is_rule(n))).cast("long").alias(f"n_{rules[n].kind}") for n in range(BASE)]
    return scanned.select("doc_id", *counts, F.sha2(_shown(base, rules), 256).alias("base_sha256"), _shown(F.col("spans"), rules).alias("spans"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


def _sql_rule(rule: Rule, number: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT row_no, {number} AS rule, '{rule.kind}' AS kind, list_zip(string_split_regex(t, '{pattern}'), regexp_extract_all(t, '{pattern}', 0), regexp_extract_all(t, '{pattern}', {rule.group})) AS parts, {rule.least} AS least FROM docs WHERE regexp_matches(t, '{pattern}')"""


ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_sql_rule(r, n) for n, r in enumerate(RULES))}),
parts AS (SELECT row_no, rule, kind, least, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM found),
placed AS (SELECT row_no, rule, kind, least, p[3] AS value, p[2] AS hit, length(coalesce(p[2], '')) AS n,
  sum(length(p[1]) + length(coalesce(p[2], ''))) OVER (PARTITION BY row_no, rule ORDER BY i) AS stop FROM parts),
spans AS (SELECT row_no, rule, stop - n AS start, concat(kind, ':', stop - n, ':', stop) AS shown FROM placed WHERE hit IS NOT NULL AND length(value) >= least),
agg AS (SELECT row_no, count(*) FILTER (rule = 0) AS n_assign, count(*) FILTER (rule = 1) AS n_access, count(*) FILTER (rule = 2) AS n_hex,
  string_agg(shown, ',' ORDER BY start, rule) FILTER (rule < {BASE}) AS base, string_agg(shown, ',' ORDER BY start, rule) AS spans FROM spans GROUP BY row_no)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN agg USING (row_no)
"""
