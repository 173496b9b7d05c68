"""Small helpers around DataFrames."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, rows: Iterable[dict], fields: str) -> DataFrame:
    """A fixed, short table as one folded literal (no Python rows at run time)."""
    values = F.from_json(F.lit(json.dumps(list(rows))), f"array<struct<{fields}>>")
    return spark.range(0, 1, 1, 1).select(F.inline(values))


#: Splits from which an input is never shuffled just to use more cores (8 GB at 128 MB each).
SPREAD_SPLITS = 64


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input too small to be split by the scan itself.

    A table of few splits, fewer than there are cores (one small file, one row group), is
    shuffled round robin, which costs little at that size.  Inputs of ``SPREAD_SPLITS`` or
    more are returned as they are, however many cores there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= min(cores, SPREAD_SPLITS):
        return df
    return df.repartition(min(cores, SPREAD_SPLITS))


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder of ``spark.checkpoint.dir``.

    Where the session names none it lies under the warehouse.  That must not be a folder of
    one machine's own, unless the session has a single machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"{warehouse}/_work"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to a work folder and read again: later steps do not repeat the earlier ones."""
    folder = work_dir(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a work folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
