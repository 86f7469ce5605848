"""Filter audits, license scans and collocations against plain definitions, and their defined cases."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from gramweave.llm import collocations, filter_audit, license_scan

SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that clash with operators' own columns, or with a table's columns by case.
CLASHING = ("Text", "DOC_ID", "part", "mask", "n", "words", "stream", "found", "id", "chunk", "first", "rows")


def clashing(df):
    return df.select("*", *[F.lit("x").alias(f"c{k}") for k in range(len(CLASHING))]).toDF(*df.columns, *CLASHING)


# -- filter audit


def fails(row, rows):
    text = row[1] or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
        "E": row[0] is not None and any(r[0] is not None and r[0] < row[0] and (r[1] or "") == text for r in rows),
    }


def audited(rows, labels):
    """By running every order over every document."""
    good = {k for k, quality, _ in labels if quality == 1}
    toxic = {k for k, _, t in labels if t == 1}
    failing = [fails(r, rows) for r in rows]
    out, shares = {}, Counter()
    for part in {r[3] or "" for r in rows}:
        own = [(r, f) for r, f in zip(rows, failing, strict=True) if (r[3] or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(r, f) for r, f in left if f[letter]]
                left = [(r, f) for r, f in left if not f[letter]]
                redundant = sum(f[letter] for _, f in own) - len(gone)
                alone = sum(f[letter] and sum(f.values()) == 1 for _, f in own)
                shares[part, letter] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), redundant, alone, sum(r[0] in good for r, _ in gone), sum(r[0] in toxic for r, _ in gone))
    return {key: (*value, shares[key[0], key[1][key[2] - 1]]) for key, value in out.items()}


def test_audit_equals_running_every_order(spark):
    rng = random.Random(3)
    texts = [None, "", "a b # c", "WORD " * 60, " ".join(f"w{k}" for k in range(80)), " ".join(f"w{k}" for k in range(80)) + " &", "x y \x1c z" * 30, "long text \U0001f600 " * 9000]
    rows = [(rng.choice([*range(40), None]), rng.choice(texts), None, rng.choice([None, "", "s", "t"])) for _ in range(120)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in [*range(0, 40, 2), 4, 4, None]]
    docs, flags = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(clashing(docs), flags).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found} == audited(rows, labels)
    assert filter_audit.audit(docs.limit(0), flags).collect() == [] and len(filter_audit.audit(docs, flags.limit(0)).collect()) == 3 * 600


def test_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(1, "a", None, "p"), (2, "bb", None, "p"), (3, "bb#", None, "p")], SCHEMA)
    flags = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    found = filter_audit.audit(docs, flags, {"S": F.col("chars") > 1, "D": F.col("text").contains("#")}, None, lost={"lost": "quality"}).collect()
    assert sorted((r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.lost, r.shapley) for r in found) == [
        ("DS", 1, 2, 1, 0, 0, 0, 1), ("DS", 2, 1, 1, 1, 1, 1, 3), ("SD", 1, 1, 2, 0, 1, 1, 3), ("SD", 2, 1, 0, 1, 0, 0, 1),
    ]
    with pytest.raises(ValueError):
        filter_audit.masks(docs, {c: F.lit(True) for c in "ABCDEFGH"})


# -- license scans


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def detections(text):
    """All matches of all rules; then those that no other one makes go, pair by pair."""
    stream = "".join(f" {w} " for w in words_of(text))
    found = [(stream[: m.start()].count(" ") // 2, stream[: m.end()].count(" ") // 2, k) for k, rule in enumerate(license_scan.RULES) for m in re.finditer(rule.pattern, stream)]

    def goes(a, b):
        p, q = license_scan.RULES[a[2]], license_scan.RULES[b[2]]
        within = b[0] <= a[0] and a[1] <= b[1] and a != b
        return within and not p.base and not q.base and (q.priority, b[1] - b[0], -b[2]) > (p.priority, a[1] - a[0], -a[2])

    return sorted((a for a in found if not any(goes(a, b) for b in found)), key=lambda s: (s[0], -s[1], s[2]))


LICENSES = (
    "Released under the MIT License.",
    "mit\nLICENSE, mit-license MIT license",
    "This work is licensed under the GNU General Public License, version 3 or any later version; see https://www.gnu.org/licenses/gpl-3.0.html",
    "SPDX-License-Identifier: Apache-2.0",
    "Licensed under the Apache License, Version 2.0 (the “License”); you may not use this file except in compliance with the License.",
    "licensed under CC BY-NC 4.0. Creative Commons Attribution-NonCommercial ShareAlike 4.0 International License",
    "limit license, commit license, mİt license, mit license",
    "All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted",
)


def test_license_rules():
    assert len(license_scan.RULES) > 300 and [r.label for r in license_scan.RULES if r.base] == ["mit", "apache", "gpl"]
    for rule in license_scan.RULES:
        assert any(stem in word for stem in license_scan.STEMS for run in rule.runs for word in run), rule
    assert {license_scan.RULES[k].label for _, _, k in detections(LICENSES[2])} == {"gpl", "gpl-3.0-or-later", "gpl-3.0"}
    assert {license_scan.RULES[k].label for _, _, k in detections(LICENSES[5])} == {"cc-by-nc-4.0", "cc-by-nc-sa-4.0"}


def test_license_scan_equals_definition(spark):
    rng = random.Random(5)
    pieces = [*LICENSES, "plain words", "version 2 0", "apache", "general public", "license", "gnu", "中文", "..."]
    texts = [None, "", "  ", *pieces, *[" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(60)]]
    docs = spark.createDataFrame([(rng.choice([1, 2, None]), t, None, None) for t in texts], SCHEMA)
    found = license_scan.scan(clashing(docs), keep=("doc_id", "text")).collect()
    want = Counter((text, len(words_of(text)), tuple(detections(text))) for text in texts)
    assert Counter((r.text, r.n_words, tuple((s.start, s.end, s.rule) for s in r.detections)) for r in found) == want
    shown = {r.doc_id: r for r in license_scan.report(license_scan.scan(spark.createDataFrame([(k, t, None, None) for k, t in enumerate([None, LICENSES[0], "x general public license mit license"])], SCHEMA))).collect()}
    assert tuple(shown[0])[1:] == (0, 0, None, None, "", "", 0.0)
    assert tuple(shown[1])[1:] == (5, 1, 3, 3, "mit", "mit", 0.9)
    assert tuple(shown[2])[1:] == (6, 2, 1, 4, "gpl,mit", "gpl,mit", 0.6)
    assert license_scan.scan(docs.limit(0)).collect() == []


def test_license_scan_of_very_long_text(spark):
    """Many detections in one text, over several blocks."""
    times = 3 * license_scan.BLOCK + 7
    text = "word " * 50_000 + "see the mit license now. " * times
    row = license_scan.report(license_scan.scan(spark.createDataFrame([(1, text, None, None)], SCHEMA))).collect()[0]
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (50_000 + 5 * times, times, 50_002, 50_002 + 5 * (times - 1))


# -- collocations


def mined(rows, words, least, percent):
    """By counting every phrase of every piece."""
    counts, totals = Counter(), Counter()
    for _, text, lang, _ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            found = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(found)
            counts.update((lang or "und", tuple(found[k : k + size])) for size in range(1, words + 1) for k in range(len(found) - size + 1))
    cands = {key: f for key, f in counts.items() if len(key[1]) > 1 and f >= least}
    out = []
    for (lang, phrase), a in cands.items():
        inside = lambda longer: len(longer) > len(phrase) and any(longer[k : k + len(phrase)] == phrase for k in range(len(longer)))  # noqa: B023, E731
        if any(other == lang and inside(longer) and 100 * f >= percent * a for (other, longer), f in cands.items()):
            continue
        cut = min((1000 * a * totals[lang] // (counts[lang, phrase[:k]] * counts[lang, phrase[k:]]), k) for k in range(1, len(phrase)))
        l, r = counts[lang, phrase[: cut[1]]], counts[lang, phrase[cut[1] :]]  # noqa: E741
        out.append((lang, " ".join(phrase), a, l, r, totals[lang], cut[0]))
    return out


@pytest.mark.parametrize(("percent", "chunk", "few"), [(100, collocations.CHUNK, collocations.BROADCAST_BYTES), (60, 64, 0), (80, 64, 1500)])
def test_collocations_equal_counting(spark, percent, chunk, few):
    rng = random.Random(percent)
    vocabulary = ["Of", "the", "a", "bé", "中", "x\x1cy", "#", "to be"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n"]) for _ in range(n))
    rows = [(k, rng.choice([None, "", text(rng.randrange(1, 60))]), rng.choice([None, "und", "en", "fr"]), None) for k in range(80)]
    rows += [(1, "one two three four five six " * 30, "en", None)] * 3 + [(2, text(9000), "en", None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    # of 64 words: many chunks of many slices, also in a task that reads one text; `few` sends names out, joins them, or both
    found = collocations.collocations(clashing(docs), least=9, percent=percent, top=None, chunk=chunk, few=few).collect()
    want = mined(rows, 5, 9, percent)
    assert Counter((r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found) == Counter(want) and len(want) > 50
    for lang in {r.lang for r in found}:
        own = sorted((r for r in found if r.lang == lang), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert own == sorted(own, key=lambda r: (-r.score, -r.a, r.phrase.encode()))
    first = collocations.collocations(docs, least=9, percent=percent, top=5).collect()
    assert {tuple(r) for r in first} == {tuple(r) for r in found if r["rank"] <= 5}


def test_slices_of_a_text_keep_all_words():
    text = b"aa bb.cc\tdd\ree " * 50
    whole = [t for part in collocations._tokens(text) for t in part]
    assert [t for part in collocations._tokens(text, 7) for t in part] == whole and len(whole) == 351


def test_collocations_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None), (None, "", "en", None), (3, ". , ;", None, None)], SCHEMA)
    assert collocations.collocations(docs).collect() == [] and collocations.collocations(docs.limit(0)).collect() == []
    big = spark.createDataFrame([(99_999_999_999_999_997, 99_999_999_999_999_998, 99_999_999_999_999_997, 99_999_999_999_999_999)], "a long, n long, l long, r long")
    a, n, l, r = big.first()  # noqa: E741
    assert big.select(collocations.exact_score(*map(F.col, "anlr"))).first()[0] == 1000 * a * n // (l * r)
