"""Scoring an unbounded query log with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from needlework import fixed
from needlework.functions.hits import Pattern
from needlework.operators.evaluate import assess
from needlework.operators.matching import distinct_score, once


def read_stream(
    spark: SparkSession,
    folder: str,
    schema,
    name: str = "*.parquet",
    files_per_batch: int = 1000,
    partitions: int | None = None,
) -> DataFrame:
    """Parquet files arriving in a folder, at most ``files_per_batch`` in a micro-batch.

    With ``partitions`` the rows are dealt out before the scan, for feeds of few files
    with many rows each.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    rows = reader.option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.repartition(partitions) if partitions else rows


def stream_score(
    log: DataFrame, patterns: Sequence[Pattern], bounds: Sequence[int] = fixed.THRESHOLDS_V1
) -> DataFrame:
    """Distinct-pattern score and class per row.

    A narrow projection without state, so it runs in append mode and gives the same
    rows as the batch form.
    """
    return assess(log.select("*", once(score=distinct_score(F.col("normalized"), list(patterns)))), bounds)


def stream_risk_windows(
    assessed: DataFrame, time: str = "ts", window: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """Queries per time window and computed class; later rows than ``delay`` drop out.

    State holds one counter per open window and class.  ``late_rows`` tells how many
    groups of rows the recent batches dropped; ``windows.run_final_windows`` keeps such rows.
    """
    counted = assessed.withWatermark(time, delay).groupBy(F.window(time, window), "computed")
    return counted.agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "computed", "n"
    )


def run_to_files(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends everything available now to parquet files, exactly once."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def run_updates_to_files(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the changed counters of every micro-batch into a folder of its own.

    A repeated batch overwrites its own folder, so a restart leaves no double rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        counts.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def late_rows(query: StreamingQuery) -> int:
    """Groups of rows that the recent micro-batches dropped because they came too late."""
    states = [state for progress in query.recentProgress for state in progress["stateOperators"]]
    return sum(state["numRowsDroppedByWatermark"] for state in states)


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The last value of every counter written by ``run_updates_to_files``."""
    return (
        spark.read.parquet(path)
        .groupBy("window_start", "window_end", "computed")
        .agg(F.max_by("n", F.col("batch")).alias("n"))
    )
