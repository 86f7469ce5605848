"""All queries of the library: name -> function of (spark, sf_dir), and name -> SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import algebra, distances, files, grammars, measurements, rows

QUERIES = {**distances.QUERIES, **grammars.QUERIES, **algebra.QUERIES, **measurements.QUERIES, **files.QUERIES, **rows.QUERIES}
ORACLES = {**distances.ORACLES, **grammars.ORACLES, **algebra.ORACLES, **measurements.ORACLES, **files.ORACLES, **rows.ORACLES}


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """Parts of one brand: pairs of names and the distances between them, by brand."""
    return distances.lev_part_pairs(spark, sf_dir)
