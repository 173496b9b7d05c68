"""Tables of timings in CSV text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needlework import fixed
from needlework.functions.text import trim_field
from needlework.tables import literal_table

HEADER = "Algorithm,"


def parse_timings(lines: DataFrame, line: str = "value") -> DataFrame:
    """Five-column lines -> timing rows; blank lines and header lines drop out.

    Other columns of ``lines`` (such as nr) are kept.
    """
    rows = lines.where((trim_field(F.col(line)) != "") & ~F.startswith(F.col(line), F.lit(HEADER)))
    fields = rows.select("*", F.split(trim_field(F.col(line)), ",", -1).alias("fields"))
    return fields.where(F.size("fields") == 5).select(
        *[c for c in lines.columns if c != line],
        F.get("fields", F.lit(0)).alias("algorithm"),
        F.get("fields", F.lit(1)).try_cast("int").alias("dataset_size"),
        F.get("fields", F.lit(2)).try_cast("int").alias("pattern_count"),
        F.get("fields", F.lit(3)).try_cast("double").alias("time_us"),
        F.get("fields", F.lit(4)).alias("risk"),
    )


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    """Timing files; nr counts the lines of one file."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_timings(files.select("file", F.posexplode(F.split("value", "\n", -1)).alias("nr", "value")))


def published_timings(spark: SparkSession) -> DataFrame:
    """The 40 published timings."""
    text = literal_table(spark, [{"value": fixed.MEASUREMENTS_CSV}], "value:string")
    return parse_timings(text.select(F.posexplode(F.split("value", "\n", -1)).alias("nr", "value")))
