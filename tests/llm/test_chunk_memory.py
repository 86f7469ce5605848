"""What a task of collocations holds at once follows the size of a chunk, not how many chunks it has."""

import gc
import random
import weakref
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from gramweave.llm import collocations

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


class Word:
    """A word that can be watched."""


def test_a_chunks_words_go_with_it():
    gc.collect()
    gc.disable()
    try:
        word, chunk = Word(), collocations._Open()
        chunk.add([word, word])
        assert chunk.numbers[word] == 1
        watched = weakref.ref(word)
        del word, chunk
        assert watched() is None
    finally:
        gc.enable()


@pytest.mark.parametrize("few", [collocations.BROADCAST_BYTES, 0])
def test_chunks_are_written_and_sent_by_few(spark, monkeypatch, few):
    """One task with many chunks, by both ways of names; the rows stay those of one chunk."""
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) + rng.choice(["", "", ".", ","]) for _ in range(300))
    docs = spark.createDataFrame([(k, text(), "en", None) for k in range(90)], "doc_id long, text string, lang string, source string").coalesce(1)
    at_once, stash, seen, before = 8192, collocations.stash, [], spark.conf.get(BATCH)

    def spy(df, tag, *args, **kwargs):
        table, limit = stash(df, tag, *args, **kwargs), spark.conf.get(BATCH)
        if tag in ("chunks", "pairs"):
            files = [pq.ParquetFile(p).metadata for p in Path(table.stash_path.removeprefix("file:")).glob("*.parquet")]
            groups = [m.row_group(k) for m in files for k in range(m.num_row_groups)]
            seen.append((tag, limit, sum(g.num_rows for g in groups), max(g.total_byte_size for g in groups)))
        return table

    monkeypatch.setattr(collocations, "stash", spy)
    monkeypatch.setattr(collocations, "AT_ONCE", at_once, raising=False)
    found = collocations.collocations(docs, words=3, least=20, top=None, chunk=256, few=few).collect()
    assert spark.conf.get(BATCH) == before
    assert [tag for tag, *_ in seen] == ["chunks", "pairs", "pairs"] and all(rows > 20 for _, _, rows, _ in seen)
    assert {limit for _, limit, _, _ in seen} == {str(at_once)}
    assert max(most for *_, most in seen) <= 2 * at_once  # of 100 rows and more before
    whole = collocations.collocations(docs, words=3, least=20, top=None).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, whole)) and len(whole) > 50
