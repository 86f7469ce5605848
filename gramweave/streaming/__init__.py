"""Distances on streams: the expressions keep no state, so they are valid on any streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramweave.functions import strings


def with_distance(stream: DataFrame, a: str = "a", b: str = "b", threshold: int | None = None) -> DataFrame:
    """Add a distance column to a stream (or a table) of pairs."""
    return stream.withColumn("distance", strings.levenshtein(F.col(a), F.col(b), threshold))
