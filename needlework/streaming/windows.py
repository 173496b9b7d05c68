"""Windows that are written once they are final, and rows that come too late for them.

Each micro-batch splits its rows at the watermark that the batches before it have left:
rows whose window was final by then go to a table of late rows, the others are added to
the counts of the open windows.  Windows that the new watermark closes are appended to
the final ones.  Final, open and late together hold every row once, however the rows were
cut into batches.  What a batch writes depends on the batch before and lies in a folder
of its own, so a repeated batch repeats its files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from needlework.tables import removed


def distinct_rows(log: DataFrame, key: Sequence[str], time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The rows of a stream without those sent again, judged by ``key``, within ``delay`` of the first.

    State holds a key until the watermark has passed its first row by ``delay``.
    """
    return log.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def run_final_windows(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    by: Sequence[str] = ("computed",),
    time: str = "ts",
    window: str = "1 day",
    delay: str = "1 hour",
) -> StreamingQuery:
    """Counts per window and ``by`` in the folders final and open, late rows in late.

    Rows without a time have no window and count as late.
    """
    spark, groups = rows.sparkSession, ["window_start", "window_end", *by]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            _write_batch(spark, batch, batch_id, path, groups, time, window, delay)
        finally:
            batch.unpersist()

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def _write_batch(spark: SparkSession, batch: DataFrame, nr: int, path: str, groups: list[str], time: str, window: str, delay: str) -> None:
    nothing = F.lit(None).cast("timestamp")
    earlier = _before(spark, f"{path}/marks", nr)
    mark = F.lit(earlier.first()["mark"]) if earlier is not None else nothing
    # a row that no window takes in is kept by its own columns
    placed = batch.withColumns(dict(zip(("window_start", "window_end"), _places(time, window), strict=True)))
    late = F.coalesce(F.col("window_end") <= mark, F.col("window_end").isNull())
    placed.where(late).drop("window_start", "window_end").write.mode("overwrite").parquet(f"{path}/late/batch={nr}")
    seen = batch.agg((F.max(time) - F.expr(f"INTERVAL {delay}")).alias("seen"))
    seen.select(F.greatest("seen", mark).alias("mark")).write.mode("overwrite").parquet(f"{path}/marks/batch={nr}")
    now = F.lit(spark.read.parquet(f"{path}/marks/batch={nr}").first()["mark"]).cast("timestamp")
    counts = placed.where(~late).groupBy(*groups).agg(F.count("*").alias("n"))
    before = _before(spark, f"{path}/open", nr)
    if before is not None:
        counts = before.select(*groups, "n").unionByName(counts).groupBy(*groups).agg(F.sum("n").alias("n"))
    closed = F.coalesce(F.col("window_end") <= now, F.lit(False))
    counts.where(closed).write.mode("overwrite").parquet(f"{path}/final/batch={nr}")
    counts.where(~closed).write.mode("overwrite").parquet(f"{path}/open/batch={nr}")
    if nr > 1:  # the batch before may have to be repeated, older ones not
        removed(spark, f"{path}/open/batch={nr - 2}")
        removed(spark, f"{path}/marks/batch={nr - 2}")


def _places(time: str, window: str) -> list[Column]:
    """Start and end of a row's window, by whole steps from the epoch; null without a time."""
    step = F.unix_micros(F.lit("1970-01-01").cast("timestamp") + F.expr(f"INTERVAL {window}")) - F.unix_micros(F.lit("1970-01-01").cast("timestamp"))
    micros = F.unix_micros(F.col(time))
    start = micros - F.pmod(micros, step)
    return [F.timestamp_micros(start), F.timestamp_micros(start + step)]


def _before(spark: SparkSession, folder: str, nr: int) -> DataFrame | None:
    """What the batch before wrote; None for the first."""
    return spark.read.parquet(f"{folder}/batch={nr - 1}") if nr else None


def final_windows(spark: SparkSession, path: str) -> DataFrame:
    """Windows that no later row can change."""
    return spark.read.parquet(f"{path}/final").drop("batch")


def open_windows(spark: SparkSession, path: str) -> DataFrame:
    """Windows as far as they have been counted."""
    states = spark.read.parquet(f"{path}/open")
    last = states.agg(F.max("batch").alias("batch"))
    return states.join(F.broadcast(last), "batch").drop("batch")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows that came after their window was final, as they came."""
    return spark.read.parquet(f"{path}/late").drop("batch")


def all_counts(spark: SparkSession, path: str, by: Sequence[str] = ("computed",), time: str = "ts", window: str = "1 day") -> DataFrame:
    """Final and open windows with the late rows added: the counts of a batch job over all rows that have a time."""
    groups = ["window_start", "window_end", *by]
    late = late_rows(spark, path).withColumns(dict(zip(groups[:2], _places(time, window), strict=True))).where(F.col(time).isNotNull())
    parts = [final_windows(spark, path), open_windows(spark, path), late.groupBy(*groups).agg(F.count("*").alias("n"))]
    every = parts[0].select(*groups, "n").unionByName(parts[1].select(*groups, "n")).unionByName(parts[2])
    return every.groupBy(*groups).agg(F.sum("n").alias("n"))
