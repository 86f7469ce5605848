"""Files that a run makes for itself, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="gramweave-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/gramweave/{tag}-{uuid.uuid4().hex}"


def written(table: DataFrame, tag: str) -> DataFrame:
    """The table written to the shared folder and read back: its lineage ends there, and lost executors take nothing along."""
    spark = table.sparkSession
    path = scratch_path(spark, tag)
    table.write.parquet(path)
    back = spark.read.schema(table.schema).parquet(path)
    back.written_to = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing lazy reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
