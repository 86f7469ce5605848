"""Where a plan is cut between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gramweave.sources.scratch import written


def kept(table: DataFrame) -> DataFrame:
    """The table, evaluated once: written to the shared folder and read back, so that nothing hangs on an executor's cache."""
    return written(table, "kept")
