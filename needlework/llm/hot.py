"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than one in so many rows are broadcast; there are fewer than that of them.
SHARE = 1024


def lookup(left: DataFrame, right: DataFrame, key: list[str], weight: str, total: int) -> DataFrame:
    """Inner join on ``key``, which is unique in ``right`` and never null.

    ``weight`` is a column of ``right`` that counts the rows of ``left`` (or of a table
    that contains it) under the key, ``total`` is the sum of all weights.  So fewer than
    ``SHARE`` keys can hold more than ``total / SHARE`` rows each: these are broadcast,
    their rows stay where they are, and all other rows are shuffled.  ``left`` is read
    twice and should be stored; ``weight`` is dropped.
    """
    values = [c for c in right.columns if c not in (*key, weight)]
    often = right.where(F.col(weight) * SHARE > F.lit(total))
    named = often.select(*key, *[F.col(c).alias(f"_often_{c}") for c in values], F.lit(True).alias("_often"))
    marked = left.join(F.broadcast(named), key, "left")
    kept = [F.col(c) for c in left.columns]
    near = marked.where(F.col("_often")).select(*kept, *[F.col(f"_often_{c}").alias(c) for c in values])
    rest = marked.where(F.col("_often").isNull()).select(*kept).join(right.drop(weight), key)
    return near.unionByName(rest.select(*near.columns))
