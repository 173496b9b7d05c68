"""Query logs: CSV-like text read by the two reader forms of the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from needlework.functions.risk import is_label
from needlework.functions.text import normalize_query, strip_outer_quotes, toggle_fields, trim_field
from needlework.tables import work_dir

#: Files up to which their first lines are sent to all tasks.
MOST_FILES = 1_000_000
SET_NAME = r"_(Low|Medium|High|Critical)_(\d+)\.csv$"


def read_log_lines(spark: SparkSession, path: str, source: bool = False) -> DataFrame:
    """Lines of every file without its first line, whatever that line holds, be it blank.

    Files stay splittable.  A file's first line is the first row of its first block; rows are
    numbered as they are read, so the smallest number of that block tells it.  Later blank
    lines are skipped.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    firsts = lines.where("block = 0").groupBy("file").agg(F.min("row").alias("row"))
    if len(lines.inputFiles()) <= MOST_FILES:
        firsts = F.broadcast(firsts)
    kept = lines.join(firsts, ["file", "row"], "left_anti").where(F.col("value").rlike(r"[^\x00-\x20]"))
    return kept.select("value", "file") if source else kept.select("value")


def parse_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Quote-toggle reader: keeps rows with two fields or more and a known label.

    Adds query, normalized and expected.
    """
    fields = lines.where(F.col(line) != "").select("*", toggle_fields(F.col(line)).alias("fields"))
    parsed = fields.where(F.size("fields") >= 2).select(
        "*",
        *[
            trim_field(strip_outer_quotes(F.get("fields", F.lit(i)))).alias(name)
            for i, name in enumerate(["query", "expected"])
        ],
    )
    return (
        parsed.where(is_label(F.col("expected")))
        .withColumn("normalized", normalize_query(F.col("query")))
        .drop("fields", line)
    )


def parse_log_naive(lines: DataFrame, line: str = "value") -> DataFrame:
    """Plain split at every comma; missing fields are empty, nothing is checked."""
    fields = lines.where(F.col(line) != "").select("*", F.split(line, ",", -1).alias("fields"))
    parsed = fields.select(
        "*",
        *[
            F.coalesce(F.get("fields", F.lit(i)), F.lit("")).alias(name)
            for i, name in enumerate(["query", "expected", "score"])
        ],
    )
    return parsed.withColumn("normalized", normalize_query(F.col("query"))).drop("fields", line)


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    """Files -> (query, expected, normalized)."""
    return parse_log(read_log_lines(spark, path))


def read_named_logs(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_query_log`` for many files at once, plus what their names tell.

    ``.._Low_100.csv`` gives set_risk ``low`` and set_size ``100``; files that are not
    there simply add no rows.
    """
    log = parse_log(read_log_lines(spark, path, source=True))
    return log.select(
        *[c for c in log.columns if c != "file"],
        F.lower(F.regexp_extract("file", SET_NAME, 1)).alias("set_risk"),
        F.regexp_extract("file", SET_NAME, 2).alias("set_size"),
    )


def read_numbered_log(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_query_log``, plus file and qid, the line number in the file.

    Files stay splittable.  Lines are written once to the work folder with their block
    and a rising number, so that both passes below see the same splits whatever happens
    to the cluster in between.  A line's number is its place in the block plus the lines
    of the blocks before it; only line counts, one row a block, are shuffled and sorted.
    The first line is dropped even if it is blank.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    placed = lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    folder = work_dir(spark, "lines")
    placed.write.parquet(folder)
    kept = spark.read.parquet(folder)
    blocks = kept.groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("row").alias("first_row"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("start", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))
    qid = F.col("start") + F.col("row") - F.col("first_row")
    numbered = kept.join(starts, ["file", "block"]).select("file", qid.alias("qid"), "value")
    return parse_log(numbered.where(F.col("qid") > 0))


def filter_valid_labels(log: DataFrame, label: str = "expected") -> DataFrame:
    return log.where(is_label(F.col(label)))
