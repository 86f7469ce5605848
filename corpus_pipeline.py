"""A corpus pipeline of five operators: quality, language, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of their documents. `run` writes every stage's result to the shared folder and reads it back as the
next one's documents; then the tables that the stage worked with, and the documents it read, are deleted.

Defined cases of all stages: columns they don't know are kept as they are, whatever their names are, also where they differ from known
ones by case only (the first is taken); rows are told apart by row, so rows of equal or null doc_id are separate documents; repeated rows are
near duplicates of each other; a null or empty text is rejected by the first two stages and, where it comes to the others alone, stays
as it is, has no near duplicate and no secret, and packs as its end id; texts of any length are worked on whole; a tie for the document that stays is
broken by doc_id (null last), then by row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramweave.llm import jaccard_join, language_id, packing, secret_scan, weak_quality
from gramweave.llm._base import cleared, stash
from gramweave.operators.spread import spread
from gramweave.sources.scratch import dropped, written

#: Languages that the corpus is meant to hold are those learnt from; a text of no language goes, and
#: so does one whose language is less sure than this. A score is a share of all languages, which is 1 / L at
#: least, so with many languages the edge is this many times that.
LEAST_LANGUAGE, LEAST_TIMES = 0.3, 1.2


def least_language(languages: int) -> float:
    """The least score of a text that stays."""
    return min(LEAST_LANGUAGE, LEAST_TIMES / languages)


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with numbers for names."""
    return docs.toDF(*[f"_{k}" for k in range(len(docs.columns))])


def _place(docs: DataFrame, name: str) -> str | None:
    """The number of the first column of a name."""
    return next((f"_{k}" for k, column in enumerate(docs.columns) if column.lower() == name), None)


def _known(docs: DataFrame, *names: str) -> DataFrame:
    """Some columns by name; one that isn't there is null."""
    places = {name: _place(docs, name) for name in names}
    return _numbered(docs).select(*[(F.col(at) if at else F.lit(None).cast("string")).alias(name) for name, at in places.items()])


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"_{k}") for k in range(len(docs.columns))]).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier keeps."""
    rows = _numbered(docs)
    scored = weak_quality.classify(rows, weak_quality.train(_known(docs, "doc_id", "text")), tuple(rows.columns), _place(docs, "text"))
    return _restored(scored.where(F.col("_score") >= weak_quality.LEAST), docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learnt, surely enough; those with a letter if none could be learnt."""
    rows, text = _numbered(docs), _place(docs, "text")
    model = language_id.train(_known(docs, "doc_id", "text", "lang"))
    if model is None:
        return _restored(rows.where(F.col(text).cast("string").rlike(r"\p{L}")), docs)
    found = language_id.identify(rows, model, tuple(rows.columns), text)
    return _restored(found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= least_language(len(model.languages)))), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts: the one whose doc_id names the group."""
    # rows are told apart by a number of their own, so that rows of equal doc_id are separate
    numbered = stash(_numbered(docs).select(F.monotonically_increasing_id().alias("_row"), "*"), "numbered")
    doc_id, text = _place(docs, "doc_id"), _place(docs, "text")
    found = jaccard_join.near_duplicates(numbered.select(F.col("_row").alias("doc_id"), F.col(text).alias("text")))
    groups = numbered.select("_row", F.col(doc_id).alias("doc_id")).join(found.select(F.col("doc_id").alias("_row"), "component_id"), "_row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    # combined before the shuffle, and met again by row, so that a large group is no group in any task
    first = groups.groupBy("component_id").agg(F.min_by("_row", order).alias("first")).select(F.col("first").alias("_row"))
    gone = stash(numbered.select("_row").join(first, "_row", "left_anti"), "gone")
    if gone.count() * 16 <= jaccard_join.BROADCAST_BYTES:
        gone = F.broadcast(gone)
    return _restored(numbered.join(gone, "_row", "left_anti"), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; n_chars follows where it was right."""
    text, n_chars = _place(docs, "text"), _place(docs, "n_chars")
    rows = _numbered(docs).withColumnsRenamed({text: "text", _place(docs, "doc_id"): "doc_id"})
    right = F.lit(False) if n_chars is None else F.coalesce(F.col(n_chars) == F.char_length("text"), F.lit(False))
    clean = secret_scan.redact(rows.withColumn("right", right))
    columns = {text: F.col("text"), _place(docs, "doc_id"): F.col("doc_id")}
    if n_chars is not None:
        columns[n_chars] = F.when(F.col("right"), F.char_length("text").cast(docs.schema[int(n_chars[1:])].dataType)).otherwise(F.col(n_chars))
    return clean.select(*[columns.get(f"_{k}", F.col(f"_{k}")) for k in range(len(docs.columns))]).toDF(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents with their places in sequences of 2048 tokens."""
    from public_tokenizers import path

    return packing.pack(_known(docs, "doc_id", "text"), path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("language ID", language), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("best-fit packing", best_fit_packing)]

#: Models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, older = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), None
    for name, stage in STAGES[:-1]:
        with cleared():
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if older is not None:
            dropped(older)
        older = docs
    return STAGES[-1][1](spark, docs, sf_dir)
