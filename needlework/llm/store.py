"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, as in tests, one under the warehouse.

    That must not be a folder of one machine's own, unless the session has a single machine.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if warehouse.startswith(("file:", "/")) and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"{warehouse}/_checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that is not needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder; a lost executor takes nothing with it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
