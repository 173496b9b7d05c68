"""Run reports: written from an assessed log, and parsed back into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needlework.operators.evaluate import run_counts

SHOWN = 10

# The line formats of a report.
QUERY_LINE = 'Query %d: "%s"'
NORMALIZED_LINE = '  Normalized: "%s"'
SCORE_LINE = "  Score: %d, computed risk: %s, expected: %s %s"
TOTAL_LINE = "Total: %d, Correct: %d, Accuracy: %s%%"
ZERO_LINE = "Queries with zero score: %d (%s%%)"
LOADED_LINE = "Loaded %d queries."
FILE_NAME = r"result_([^_/]+)_[^/]*_(Low|Medium|High|Critical)_(\d+)\.txt$"


def six_digits(x: Column) -> Column:
    """A number, not negative, with six significant digits and no trailing zeros.

    ``68``, ``85.7143``, ``0.000123457``; ``1.23457e-05`` below a ten-thousandth and
    ``1.23457e+06`` from a million on.
    """
    scientific = F.format_string("%.5e", x)
    exponent = F.regexp_extract(scientific, r"e([+-]\d+)$", 1)
    plain = scientific.cast("decimal(38,18)").cast("string")
    short = F.regexp_replace(F.regexp_extract(scientific, r"^([\d.]+)e", 1), r"\.?0+$", "")
    power = exponent.cast("int")
    fixed_point = F.regexp_replace(plain, r"\.?0+$", "")
    return F.when(x == 0, "0").when((power < -4) | (power > 5), F.concat(short, F.lit("e"), exponent)).otherwise(fixed_point)


def first_rows(log: DataFrame, dims: list[str], key: str = "qid") -> DataFrame:
    """The rows a report shows; taken from the plain log, so only they get scored twice.

    The window limits each group inside every map task, before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(*dims).orderBy(key))
    return log.withColumn("nr", rank).where(F.col("nr") <= SHOWN)


def report_texts(assessed: DataFrame, shown: DataFrame, dims: list[str]) -> DataFrame:
    """(dims, value): one report per data set, with its first rows and totals.

    ``shown`` is the assessed form of ``first_rows``.
    """
    nr = F.col("nr") - 1
    block = F.concat_ws(
        "\n",
        F.format_string(QUERY_LINE, nr, F.col("query")),
        F.format_string(NORMALIZED_LINE, F.col("normalized")),
        F.format_string(SCORE_LINE, F.col("score"), F.col("computed"), F.col("expected"), F.col("flag")),
    )
    blocks = shown.groupBy(*dims).agg(F.sort_array(F.collect_list(F.struct("nr", block.alias("block")))).alias("b"))
    totals = assessed.groupBy(*dims).agg(*run_counts())
    percent = {c: six_digits(F.lit(100.0) * F.col(c) / F.col("total")) for c in ("correct", "zero_scores")}
    value = F.concat_ws(
        "\n",
        F.format_string(LOADED_LINE, F.col("total")),
        F.array_join(F.transform("b", lambda x: x["block"]), "\n"),
        F.lit(""),
        F.format_string(TOTAL_LINE, F.col("total"), F.col("correct"), percent["correct"]),
        F.format_string(ZERO_LINE, F.col("zero_scores"), percent["zero_scores"]),
    )
    return blocks.join(totals, dims).select(*dims, value.alias("value"))


def write_run_reports(assessed: DataFrame, shown: DataFrame, path: str, dims: list[str]) -> None:
    """One text file per data set under ``dim=value`` folders."""
    report_texts(assessed, shown, dims).write.mode("overwrite").partitionBy(*dims).option("lineSep", "\n").text(path)


def write_run_metrics(metrics: DataFrame, path: str, dims: list[str]) -> None:
    """The totals of the reports as a table, partitioned like the reports."""
    metrics.write.mode("overwrite").partitionBy(*dims).parquet(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per report file, with its path and partition folders, if any."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=False)
    return files.select("*", F.col("_metadata.file_path").alias("file"))


def _number(pattern: str, kind: str) -> Column:
    return F.regexp_extract("value", pattern, 1).try_cast(kind)


def parse_reports(reports: DataFrame) -> DataFrame:
    """Totals of each report: all columns but ``value``, plus the numbers found in it.

    Algorithm, class and size also come from the file name where it tells them; lines a
    report lacks give null.
    """
    named = {
        "file_algorithm": F.nullif(F.regexp_extract("file", FILE_NAME, 1), F.lit("")),
        "file_risk": F.nullif(F.lower(F.regexp_extract("file", FILE_NAME, 2)), F.lit("")),
        "file_size": F.regexp_extract("file", FILE_NAME, 3).try_cast("int"),
    }
    numbers = {
        "patterns": _number(r"(?:Extracted|Successfully read) (\d+) patterns", "int"),
        "loaded": _number(r"Loaded (\d+) queries", "bigint"),
        "total": _number(r"(?m)^Total: (\d+), ", "bigint"),
        "correct": _number(r"(?m)^Total: \d+, Correct: (\d+)", "bigint"),
        "accuracy": _number(r"(?m)^Total: .*Accuracy: ([0-9.eE+-]+)%", "double"),
        "zero_scores": _number(r"Queries with zero score: (\d+)", "bigint"),
        "kernel_ms": _number(r"kernel execution time: ([0-9.eE+-]+) ms", "double"),
    }
    kept = [c for c in reports.columns if c != "value"]
    return reports.select(*kept, *[c.alias(n) for n, c in {**named, **numbers}.items()])


# Query block of the current reports; older ones have one line per query.
# The texts may span lines; the marker of the next line ends them.  The expected class is
# any text: logs split at the wrong comma put the rest of the query there.
_BLOCK = (
    r'(?s)(?:^|\n)Query (\d+): "(.*?)"\n  Normalized: "(.*?)"\n'
    r"  Score: (-?\d+), computed risk: (\w+), expected: (.*?) \[(OK|Mismatch)\]"
)
_SHORT = r"(?m)^Query (\d+): computed=(\w+), expected=(.*?)(?:, score=(-?\d+))?(?: \[\w+\])?$"


def parse_report_queries(reports: DataFrame) -> DataFrame:
    """The queries shown in each report: nr, query, normalized, score, computed, expected, flag."""
    kept = [c for c in reports.columns if c != "value"]
    blocks = reports.select(*kept, F.explode(F.regexp_extract_all("value", F.lit(_BLOCK), F.lit(0))).alias("block"))

    def part(i: int) -> Column:
        return F.regexp_extract("block", _BLOCK, i)

    full = blocks.select(
        *kept,
        part(1).cast("int").alias("nr"),
        part(2).alias("query"),
        part(3).alias("normalized"),
        part(4).cast("bigint").alias("score"),
        part(5).alias("computed"),
        part(6).alias("expected"),
        F.concat(F.lit("["), part(7), F.lit("]")).alias("flag"),
    )
    lines = reports.select(*kept, F.explode(F.regexp_extract_all("value", F.lit(_SHORT), F.lit(0))).alias("block"))
    computed, expected = F.regexp_extract("block", _SHORT, 2), F.regexp_extract("block", _SHORT, 3)
    short = lines.select(
        *kept,
        F.regexp_extract("block", _SHORT, 1).cast("int").alias("nr"),
        F.lit(None).cast("string").alias("query"),
        F.lit(None).cast("string").alias("normalized"),
        F.regexp_extract("block", _SHORT, 4).try_cast("bigint").alias("score"),
        computed.alias("computed"),
        expected.alias("expected"),
        F.when(computed == expected, "[OK]").otherwise("[Mismatch]").alias("flag"),
    )
    return full.unionByName(short)
