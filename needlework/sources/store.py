"""A store of data sets by class and size.

One folder per class and size, ``set_risk=low/set_size=100``.  Writing replaces the folders
that the rows belong to and no others; reading some sets by name touches only theirs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from needlework.tables import removed

SET = ["set_risk", "set_size"]
FIELDS = "query string, expected string, normalized string, set_risk string, set_size bigint"
NAME = re.compile(r"(?:.*_)?(Low|Medium|High|Critical)_(\d+)(?:\.csv)?$", re.IGNORECASE)


def write_sets(rows: DataFrame, path: str) -> None:
    """Replaces every set that ``rows`` (set_risk, set_size and any columns) holds, whole; other sets stay.

    Rows are brought together by set and a part of their hash, so a large set is written by several tasks.
    """
    parts = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in SET]), F.lit(16))
    writer = rows.repartition(*SET, parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*SET).parquet(path)


def named(names: Sequence[str]) -> Column:
    """Whether a row belongs to one of the sets, named like ``Low_100`` or ``.._High_10.csv``."""
    wanted = F.lit(False)
    for name in names:
        found = NAME.match(name)
        if not found:
            raise ValueError(f"no class and size in {name!r}")
        wanted = wanted | ((F.col("set_risk") == found[1].lower()) & (F.col("set_size") == int(found[2])))
    return wanted


def read_sets(spark: SparkSession, path: str, names: Sequence[str] | None = None, fields: str = FIELDS) -> DataFrame:
    """All sets, or those of the given names; names that the store lacks add no rows."""
    rows = spark.read.schema(fields).parquet(path)
    return rows if names is None else rows.where(named(names))


def drop_set(spark: SparkSession, path: str, risk: str, size: int) -> None:
    removed(spark, f"{path}/set_risk={risk}/set_size={size}")
