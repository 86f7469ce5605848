"""License scanning by ordered signature rules, in DataFrame functions only.

A text becomes its stream of words, so that line breaks and punctuation between the words of a license don't matter.
Rules are regexes over words: tags, addresses, notices, sentences that grant a license by name, and bare names. Three gates
keep the regexes from most texts: the plain text must hold one of a few stems (every rule asks for a word with one of them), the stream
must hold the rule's keyword (its longest run of mandatory words), and only then the regex runs. Of
overlapping detections, one that lies within another of a higher priority goes, as does one within a longer (or equal, but
earlier ruled) one of its own priority. The base phrases always stay and make nothing else go.

Rows stay where they are: nothing is shuffled, and any columns can be kept.

Defined cases: null or empty text has no word, no detection and score 0; doc_id plays no part, so rows of equal or null
doc_id are scanned one by one; equal intervals are told apart by priority, then by the rules' order; an empty table
gives no row; kept columns may have any name; texts and detections of any number: lists grow in blocks, so the work is near linear.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramweave.operators.spread import spread

from ._base import column

#: Base phrases and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Priorities: what stands in an interval of a higher one goes. Then how sure a detection of the kind makes.
BARE, GRANT, TEXT, LINK, TAG = 0, 1, 2, 3, 4
SURE = {BARE: 0.6, GRANT: 0.9, TEXT: 0.9, LINK: 0.95, TAG: 1.0}
BASE_SURE = 0.5
#: Any rule asks for a word that holds one of these.
STEMS = ("licen", "spdx", "creative", "publicdomain", "opensource", "granted", "redistribution", "unencumbered", "copyleft", "mozilla", "wtfpl", "rights", "domain")
#: Detections of a block.
BLOCK = 512


@dataclass(frozen=True)
class Rule:
    label: str
    #: Words and groups of words: blanks only separate; `(x y)?` is optional, `(x|y)` a choice.
    words: str
    priority: int
    base: bool = False

    @property
    def tokens(self) -> list[str]:
        return re.findall(r"\)\?|[a-z0-9\[\]]+\??|[()|]", self.words)

    @property
    def pattern(self) -> str:
        """The regex over a stream in which each word has a space on either side."""
        return "".join(t if t[0] in "()|" else f" {t} " for t in self.tokens)

    @property
    def runs(self) -> list[list[str]]:
        """Runs of words that any match holds."""
        found, depth = [[]], 0
        for t in self.tokens:
            depth += (t == "(") - (t[0] == ")")
            if t[0] in "()|" or not t.isalnum():
                found.append([])
            elif depth == 0:
                found[-1].append(t)
        return [run for run in found if run]

    @property
    def keyword(self) -> str:
        return max(("".join(f" {w} " for w in run) for run in self.runs), key=len)


def _version(major: int | str, minor: int | None = 0, optional: bool = False) -> str:
    tail = "" if minor is None else f"( {minor})?" if minor == 0 else f" {minor}"
    return f" (version {major}{tail}|v {major}{tail}|v{major}{tail}|{major}{tail})" + ("?" if optional else "")


def _spdx(label: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", label)


def _families() -> dict[str, str]:
    """Labels and names of licenses that come in versions or parts."""
    later = "( or)?( at your option)? any later( version)?"
    found = {}
    for label, name, versions in (
        ("gpl", "general public license", ((1, 0), (2, 0), (3, 0))), ("lgpl", "(lesser|library) general public license", ((2, 0), (2, 1), (3, 0))), ("agpl", "affero general public license", ((1, 0), (3, 0))),
        ("gfdl", "free documentation license", ((1, 1), (1, 2), (1, 3))),
    ):
        for major, minor in versions:
            found[f"{label}-{major}.{minor}"] = f"(gnu )?{name}{_version(major, minor)}"
            found[f"{label}-{major}.{minor}-or-later"] = f"(gnu )?{name}{_version(major, minor)}{later}"
    for label, name, versions in (
        ("apache", "apache( software)? license", ((1, 0), (1, 1), (2, 0))), ("mpl", "mozilla public license", ((1, 0), (1, 1), (2, 0))), ("epl", "eclipse public license", ((1, 0), (2, 0))),
        ("cddl", "common development and distribution license", ((1, 0), (1, 1))), ("eupl", "european union public license", ((1, 0), (1, 1), (1, 2))), ("artistic", "artistic license", ((1, 0), (2, 0))),
        ("afl", "academic free license", ((2, 1), (3, 0))), ("osl", "open software license", ((2, 1), (3, 0))), ("lppl", "latex project public license", ((1, 2), (1, 3))), ("php", "php license", ((3, 0), (3, 1))),
        ("ecl", "educational community license", ((1, 0), (2, 0))), ("cecill", "cecill license", ((2, 0), (2, 1))), ("zpl", "zope public license", ((2, 0), (2, 1))), ("elastic", "elastic license", ((1, 0), (2, 0))),
    ):
        for major, minor in versions:
            found[f"{label}-{major}.{minor}"] = f"{name}{_version(major, minor)}"
    terms = {"by": "attribution", "sa": "(sharealike|share alike)", "nc": "(noncommercial|non commercial)", "nd": "(noderivatives|no derivatives|noderivs)"}
    for parts in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
        for major, minor in ((1, 0), (2, 0), (2, 5), (3, 0), (4, 0)):
            long = " ".join(terms[p] for p in parts.split("-"))
            found[f"cc-{parts}-{major}.{minor}"] = f"creative commons ({_spdx(parts)}|{long}){_version(major, minor)}( international| unported| generic)?( public)?( license)?"
    return found


#: Licenses of one form: the label and the name.
NAMES = {
    "mit": "mit license",
    "mit-0": "mit no attribution license",
    "x11": "x11 license",
    "bsd-2-clause": "(bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) license",
    "bsd-3-clause": "(bsd 3 clause|3 clause bsd|three clause bsd|new bsd|revised bsd|modified bsd) license",
    "bsd-4-clause": "(bsd 4 clause|4 clause bsd|four clause bsd|original bsd) license",
    "0bsd": "(0bsd|zero clause bsd|bsd zero clause) license",
    "isc": "isc license",
    "zlib": "zlib( libpng)? license",
    "bsl-1.0": "boost software license( version)?( 1 0)?",
    "unlicense": "the unlicense",
    "wtfpl": "do what the fuck you want to public license",
    "cc0-1.0": "creative commons (zero|cc0)( 1 0)?( universal)?",
    "ofl-1.1": "(sil )?open font license( version)?( 1 1)?",
    "odbl-1.0": "(open data commons )?open database license( version| v)?( 1 0)?",
    "odc-by-1.0": "(open data commons )?attribution license( version| v)?( 1 0)?",
    "pddl-1.0": "public domain dedication and license",
    "psf-2.0": "python software foundation license",
    "ruby": "ruby license",
    "openssl": "openssl license",
    "postgresql": "postgresql license",
    "ncsa": "(university of illinois )?ncsa open source license",
    "w3c": "w3c software( notice and| and document)? license",
    "vim": "vim license",
    "curl": "curl license",
    "beerware": "(beer ware|beerware) license",
    "json": "json license",
    "ms-pl": "microsoft public license",
    "ms-rl": "microsoft reciprocal license",
    "cpl-1.0": "common public license( version| v)?( 1 0)?",
    "ipl-1.0": "ibm public license( version| v)?( 1 0)?",
    "rpl-1.5": "reciprocal public license( version| v)?( 1 5)?",
    "sspl-1.0": "server side public license( version| v)?( 1)?",
    "busl-1.1": "business source license( version)?( 1 1)?",
    "commons-clause": "commons clause license condition",
    "unicode": "unicode license agreement",
    "upl-1.0": "universal permissive license( version| v)?( 1 0)?",
    "mulanpsl-2.0": "mulan permissive software license( version| v)?( 2)?",
    "blueoak-1.0.0": "blue oak model license",
    "openrail": "openrail( m)? license",
}

#: Sentences of license texts and notices, and addresses.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", TEXT),
    ("isc", "permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted", TEXT),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", TEXT),
    ("gpl-or-later", "redistribute it and or modify it under the terms of the gnu( lesser| affero)? general public license as published by the free software foundation", TEXT),
    ("unlicense", "this is free and unencumbered software released into the public domain", TEXT),
    ("apache-2.0", "you may not use this file except in compliance with the license", TEXT),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", TEXT),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", TEXT),
    ("public-domain", "(dedicated|released|placed) (to|into|in) the public domain", TEXT),
    ("all-rights-reserved", "all rights reserved", BARE),
    ("copyleft", "copyleft", BARE),
    ("apache-2.0", "apache org licenses license 2 0", LINK),
    ("apache-1.1", "apache org licenses license 1 1", LINK),
    ("mpl-2.0", "mozilla org( en us)? mpl 2 0", LINK),
    ("mpl-1.1", "mozilla org mpl 1 1", LINK),
    ("gpl-2.0", "gnu org licenses( old licenses)? gpl 2 0", LINK),
    ("gpl-3.0", "gnu org licenses gpl( 3 0)?", LINK),
    ("lgpl-2.1", "gnu org licenses( old licenses)? lgpl 2 1", LINK),
    ("lgpl-3.0", "gnu org licenses lgpl( 3 0)?", LINK),
    ("agpl-3.0", "gnu org licenses agpl( 3 0)?", LINK),
    ("gfdl-1.3", "gnu org licenses fdl( 1 3)?", LINK),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0", LINK),
    ("wtfpl", "wtfpl net", LINK),
    ("unlicense", "unlicense org", LINK),
)


def _rules() -> tuple[Rule, ...]:
    """The rules in order: base phrases first, then each license's forms, then the sentences and addresses."""
    found = [Rule(label, words, BARE, True) for words, label in PHRASES.items()]
    names = _families() | NAMES
    for label, name in names.items():
        spdx = _spdx(label)
        grant = "(licensed|released|distributed|redistributed|available|published|provided|covered) (under|by|with) (the )?(terms( and conditions)? of )?(the )?"
        found += [Rule(label, f"spdx license identifier {spdx}", TAG), Rule(label, f"spdx org licenses {spdx}", LINK), Rule(label, f"opensource org (license|licenses) {spdx}", LINK), Rule(label, grant + name, GRANT), Rule(label, name, BARE)]
        if label.startswith("cc-"):
            found += [Rule(label, f"creativecommons org licenses {spdx.removeprefix('cc ')}", LINK), Rule(label, f"licensed under (a )?(the )?cc {spdx.removeprefix('cc ')}", GRANT), Rule(label, f"{spdx} license", BARE)]
    return (*found, *(Rule(label, words, priority) for label, words, priority in TEXTS))


RULES = _rules()

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of a text in either case.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _fold(items: Column, carry: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What `step(carry, item) -> (carry, emitted array)` emits, in order. Blocks of items gather what they emit by themselves."""
    none = F.array().cast(f"array<{kind}>")

    def inner(state: Column, item: Column) -> Column:
        after, emitted = step(state["carry"], item)
        return F.struct(after.alias("carry"), F.concat(state["out"], emitted).alias("out"))

    def outer(state: Column, block: Column) -> Column:
        return F.aggregate(block, F.struct(state["carry"].alias("carry"), none.alias("out")), inner, lambda s: F.struct(s["carry"].alias("carry"), F.concat(state["out"], s["out"]).alias("out")))

    def folded(all_items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_items, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(all_items) > 0, F.aggregate(blocks, F.struct(carry.alias("carry"), none.alias("out")), outer, lambda s: s["out"])).otherwise(none)

    return F.get(F.transform(F.array(items), folded), F.lit(0))  # so that the items are made once


SPAN = "struct<start:int,end:int,rule:int>"


def _places(stream: Column, pattern: Column, rule: Column) -> Column:
    """[(start, end, rule)] of a rule's matches, in words: gaps and matches alternate, so their words add up to places."""
    parts = F.arrays_zip(F.split(stream, pattern, -1).alias("gap"), F.regexp_extract_all(stream, pattern, F.lit(0)).alias("hit"))
    words = lambda piece: ((F.char_length(piece) - F.char_length(F.replace(piece, F.lit(" "), F.lit("")))) / 2).cast("int")

    def step(at: Column, part: Column) -> tuple[Column, Column]:
        start = at + words(part["gap"])
        end = start + F.coalesce(words(part["hit"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end"), rule.alias("rule")))
        return end, F.when(part["hit"].isNotNull(), span).otherwise(F.array().cast(f"array<{SPAN}>"))

    return _fold(parts, F.lit(0), step, SPAN)


def _standing(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """The spans by start that no other makes go: one pass that keeps the farthest end for each priority and those above it."""
    priority = lambda s: F.get(F.lit([r.priority for r in rules]), s["rule"])
    base = lambda s: F.get(F.lit([r.base for r in rules]), s["rule"])
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), (-priority(s)).alias("rank"), s["rule"].alias("rule"), s["end"].alias("end")))

    def step(farthest: Column, s: Column) -> tuple[Column, Column]:
        own = F.get(F.lit([r.priority for r in rules]), s["rule"])
        after = F.when(base(s), farthest).otherwise(F.transform(farthest, lambda end, p: F.when(p <= own, F.greatest(end, s["end"])).otherwise(end)))
        span = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rule"].alias("rule")))
        return after, F.when(base(s) | (F.get(farthest, own) < s["end"]), span).otherwise(F.array().cast(f"array<{SPAN}>"))

    return _fold(F.array_sort(order), F.lit([-1] * (1 + max(r.priority for r in rules))), step, SPAN)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id", "text"), text: str = "text") -> DataFrame:
    """The kept columns of each row, `n_words` and `detections`: [(start, end, rule)] in words by start, then the longest."""
    rows = docs.toDF(*[f"_{k}" for k in range(len(docs.columns))])
    own = F.coalesce(F.col(column(docs, text)).cast("string"), F.lit(""))
    rows = rows.select(*[F.col(column(docs, c)).alias(f"kept{k}") for k, c in enumerate(keep)], own.alias("whole"))
    kept = [f"kept{k}" for k in range(len(keep))]
    rows = rows.select(*kept, "whole", F.lower("whole").alias("low"))  # a column, so that it is made once for all stems
    gate = reduce(lambda a, b: a | b, [F.contains("low", F.lit(stem)) for stem in STEMS])
    stream = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate("whole", _UPPER, _LOWER), _BETWEEN, "  ")), F.lit(" "))
    rows = rows.select(*kept, F.regexp_count("whole", F.lit(_WORD)).cast("long").alias("n_words"), F.when(gate, stream).alias("stream"))
    keywords, patterns = F.lit([r.keyword for r in rules]), F.lit([r.pattern for r in rules])
    asked = F.filter(F.sequence(F.lit(0), F.lit(len(rules) - 1)), lambda r: F.contains(F.col("stream"), F.get(keywords, r)))
    found = F.flatten(F.transform(asked, lambda r: _places(F.col("stream"), F.get(patterns, r), r)))
    rows = rows.select(*kept, "n_words", F.when(F.col("stream").isNotNull(), found).otherwise(F.array().cast(f"array<{SPAN}>")).alias("found"))
    return rows.select(*kept, "n_words", _standing(F.col("found"), rules).alias("detections")).toDF(*keep, "n_words", "detections")


def report(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and places of the base phrases, labels, and how sure the surest detection makes."""
    base_count = sum(r.base for r in rules)  # they come first
    base = F.filter("detections", lambda s: s["rule"] < base_count)
    starts = F.transform(base, lambda s: s["start"].cast("long"))
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.get(F.lit([r.label for r in rules]), s["rule"])))), ",")
    sure = F.transform("detections", lambda s: F.get(F.lit([BASE_SURE if r.base else SURE[r.priority] for r in rules]), s["rule"]))
    return scanned.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("detections")).alias("labels"), F.coalesce(F.array_max(sure), F.lit(0.0)).alias("score"))


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), keep=("doc_id",)))


_ROWS = ", ".join(f"({k}, '{r.label}', '{r.pattern}', '{r.keyword}', {r.priority}, {BASE_SURE if r.base else SURE[r.priority]}, {str(r.base).lower()})" for k, r in enumerate(RULES))
ORACLE = rf"""
WITH rules(rule, label, pattern, keyword, priority, sure, base) AS (VALUES {_ROWS}),
docs AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
streams AS (SELECT row_no, concat(' ', array_to_string(w, '  '), ' ') AS t FROM docs WHERE len(w) > 0),
asked AS (SELECT row_no, t, rule, pattern FROM streams JOIN rules ON contains(t, keyword)),
parts AS (SELECT row_no, rule, unnest(list_zip(string_split_regex(t, pattern), regexp_extract_all(t, pattern))) AS p, generate_subscripts(list_zip(string_split_regex(t, pattern), regexp_extract_all(t, pattern)), 1) AS i FROM asked),
placed AS (SELECT row_no, rule, p[2] AS hit, (length(p[2]) - length(replace(p[2], ' ', ''))) // 2 AS n,
  sum((length(p[1]) - length(replace(p[1], ' ', ''))) // 2 + coalesce((length(p[2]) - length(replace(p[2], ' ', ''))) // 2, 0)) OVER (PARTITION BY row_no, rule ORDER BY i) AS stop FROM parts),
spans AS (SELECT row_no, rule, (stop - n)::BIGINT AS start, stop::BIGINT AS stop, label, priority, sure, base FROM placed JOIN rules USING (rule) WHERE hit IS NOT NULL),
stand AS (SELECT * FROM spans a WHERE base OR NOT EXISTS (SELECT 1 FROM spans b WHERE b.row_no = a.row_no AND NOT b.base AND b.rule <> a.rule AND b.start <= a.start AND b.stop >= a.stop
  AND (b.priority > a.priority OR b.priority = a.priority AND (b.stop - b.start > a.stop - a.start OR b.rule < a.rule)))),
agg AS (SELECT row_no, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(sure) AS score FROM stand GROUP BY row_no)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM docs LEFT JOIN agg USING (row_no)
"""
