"""Evaluation that is added to: partial results per data set that are stored and merged.

A state holds the counts behind accuracy and zero share and a sketch of the scores, for one
set and class.  States of several sets merge into that of all their rows, so a further
set reads only itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needlework.sources.store import SET

COUNTS = ["total", "correct", "zero_scores", "score_sum"]
FIELDS = "expected string, total bigint, correct bigint, zero_scores bigint, score_sum bigint, min_score bigint, max_score bigint, scores binary, set_risk string, set_size bigint"


def states(assessed: DataFrame, dims: Sequence[str] = (*SET, "expected")) -> DataFrame:
    """Per ``dims`` the counts, least and largest score and a sketch of the scores."""
    score = F.col("score").cast("bigint")
    return assessed.groupBy(*dims).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("computed") == F.col("expected")).alias("correct"),
        F.count_if(score == 0).alias("zero_scores"),
        F.coalesce(F.sum(score), F.lit(0)).cast("bigint").alias("score_sum"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.kll_sketch_agg_bigint(score).alias("scores"),
    )


def merged(found: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """States merged over everything but ``dims``."""
    return found.groupBy(*dims).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in COUNTS],
        F.min("min_score").alias("min_score"),
        F.max("max_score").alias("max_score"),
        F.kll_merge_agg_bigint("scores").alias("scores"),
    )


def add_sets(assessed: DataFrame, path: str) -> None:
    """Writes the states of the sets in ``assessed`` (set_risk, set_size); a set that is there is replaced."""
    rows = states(assessed)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SET).parquet(path)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIELDS).parquet(path)


def results(found: DataFrame) -> DataFrame:
    """States with accuracy and zero share in percent, mean and (by the sketch) middle score."""
    total = F.col("total")
    return found.select(
        *[c for c in found.columns if c not in ("scores", "score_sum")],
        (100.0 * F.col("correct") / total).alias("accuracy"),
        (100.0 * F.col("zero_scores") / total).alias("zero_share"),
        (F.col("score_sum") / total).alias("avg_score"),
        F.kll_sketch_get_quantile_bigint("scores", F.lit(0.5)).alias("middle_score"),
    )
