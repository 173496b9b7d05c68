"""Scoring a stream with a dictionary that changes while the stream runs.

The dictionary is a table to which versions are added, each with the time from which it
holds.  A row is scored by the version that holds at the row's own time, whenever it is
processed; so a restart, or a second run over the same files, repeats every score as
long as versions are announced before their time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from needlework import fixed
from needlework.operators.dictionary import merged_weights
from needlework.operators.evaluate import assess
from needlework.operators.matching import distinct_score, once, small_patterns, with_scores


def score_by_version(
    log: DataFrame, versions: DataFrame, key: str = "qid", time: str = "ts", bounds: Sequence[int] = fixed.THRESHOLDS_V1
) -> DataFrame:
    """The rows with ``valid_from`` (their version), score and class, for a table read at once.

    ``versions`` has valid_from, pid, pattern and weight; a row from before all of them has
    a null version and the score 0, as has a row without a time.  The starts of the versions
    and, of short ones, the patterns come to the driver; one scan per version in use.
    """
    starts = sorted(r["valid_from"] for r in versions.select("valid_from").distinct().collect())
    holding = F.lit(None).cast("timestamp")
    for start in starts:
        holding = F.when(F.col(time) >= F.lit(start), F.lit(start)).otherwise(holding)
    placed = log.withColumn("valid_from", holding)
    parts = [placed.where(F.col("valid_from").isNull()).withColumn("score", F.lit(0).cast("bigint"))]
    for start in starts:
        rows = placed.where(F.col("valid_from") == F.lit(start))
        words = versions.where(F.col("valid_from") == F.lit(start)).drop("valid_from")
        patterns = small_patterns(words)
        if patterns is not None:
            parts.append(rows.select("*", once(score=distinct_score(F.col("normalized"), patterns))))
        else:
            parts.append(with_scores(rows, merged_weights(words), {"score": F.col("weight")}, key))
    return assess(reduce(DataFrame.unionByName, parts), bounds)


def run_versioned_score(
    log: DataFrame, versions_path: str, path: str, checkpoint: str, key: str = "qid", time: str = "ts"
) -> StreamingQuery:
    """Scores every micro-batch by the versions that the table holds when the batch is processed.

    A repeated batch overwrites its own folder, so a restart leaves no double rows.
    """
    spark = log.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = score_by_version(batch, spark.read.parquet(versions_path), key, time)
        scored.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        log.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def versioned_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")
