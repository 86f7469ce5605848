"""Work for all cores from small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes a core up to which an input counts as small.
SMALL = 32 << 20


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt over the session's cores, if they come from fewer files than that and are few.

    A file of one row group is one task, however many cores wait; kernels are worth a small shuffle
    then. Inputs of many files, or large ones, stay as they are read.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > cores * SMALL or not 0 < len(rows.inputFiles()) < cores:
        return rows
    return rows.repartition(cores)
