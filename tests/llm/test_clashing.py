"""Columns that clash by case with an operator's own change nothing, in any operator or pipeline stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gramweave.llm import ann, fingerprints, html_extract, jaccard_join, language_id, packing, secret_scan, token_files, weak_quality, word_shuffle
from gramweave.sources.scratch import scratch_path

P = pytest.importorskip("public_tokenizers")
NAMES = ("Text", "DOC_ID", "Lang", "HTML", "Url", "PAGE_ID", "Embedding", "VEC_ID", "h", "key", "row", "score", "_0")


def clashing(df):
    return df.select("*", *[F.lit("x").alias(f"c{k}") for k in range(len(NAMES))]).toDF(*df.columns, *NAMES)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    words = ["the", "quick", "brown", "fox", "und", "der", "Hund", "springt", "über", "token=abcdef123"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))), rng.choice(["en", "de", None]), 1) for k in range(40)]
    rows += [(100, None, "en", None), (101, "", None, 0), (None, "no id", "en", 5), (102, rows[3][1], "en", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")


def tokens(docs):
    target = scratch_path(docs.sparkSession, "clash")
    token_files.write_token_files(docs, target, P.path("byte_bpe_50k.json"))
    return token_files.read_token_files(docs.sparkSession, target)


OPERATORS = {
    "op1": tokens,
    "op3": lambda d: weak_quality.classify(d, weak_quality.train(d)),
    "op4": lambda d: language_id.identify(d, language_id.train(d)),
    "op5": lambda d: word_shuffle.encode_and_decode(d, P.path("byte_bpe_50k.tiktoken"), digests=True),
    "op6": fingerprints.compare_with_next,
    "op7": lambda d: packing.pack(d, P.path("word_bpe_49k.json")).drop("sequence_id", "offset"),
    "op9": jaccard_join.near_duplicates,
    "op10": lambda d: secret_scan.scan(d),
}


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators(docs, name):
    assert rows(OPERATORS[name](clashing(docs))) == rows(OPERATORS[name](docs))


def test_nearest_neighbours(spark):
    rng = random.Random(3)
    vectors = spark.createDataFrame([(k, [rng.random() for _ in range(4)]) for k in range(60)], "vec_id long, embedding array<double>")
    find = lambda v: ann.neighbours(v, F.col("vec_id") % 10 == 0)
    assert rows(find(clashing(vectors))) == rows(find(vectors))


def test_html(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<html><body><nav>menu</nav><p>Some words of page {k}, and more.</p></body></html>") for k in range(9)], "page_id long, url string, html string")
    assert rows(html_extract.extract(clashing(pages))) == rows(html_extract.extract(pages))


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, docs, stage):
    run = corpus_pipeline.STAGES[stage][1]
    found = run(spark, clashing(docs), "")
    if stage == 4:
        assert rows(found.drop("sequence_id", "offset")) == rows(run(spark, docs, "").drop("sequence_id", "offset"))
    else:
        assert found.columns == clashing(docs).columns
        assert rows(found.toDF(*[str(k) for k in range(len(found.columns))]).select("0", "1", "2", "3")) == rows(run(spark, docs, "").toDF("0", "1", "2", "3"))
