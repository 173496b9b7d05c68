"""Pattern files: five formats, each a function over the text of a file or a line.

A pattern file is one row (``value`` = whole file).  Dictionaries are small; texts to
be scanned never come through here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from needlework.functions.text import FIELD_BLANKS, trim_field

QUOTED = '"([^"]+)"'
WEIGHTED = r"(?s)^(.*),(\d+)$"


def read_pattern_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def quoted_patterns(content: Column) -> Column:
    """Everything between a pair of quotes, over the whole file.

    Pairs are formed from left to right across lines, so a pattern that itself starts
    with a quote shifts the phase: the engine's dictionary depends on that.
    One trailing comma is dropped; empty patterns are skipped.
    """
    found = F.regexp_extract_all(content, F.lit(QUOTED), F.lit(1))
    trimmed = F.transform(found, lambda p: F.regexp_replace(p, r",\z", ""))
    return F.filter(trimmed, lambda p: p != "")


def line_patterns(content: Column) -> Column:
    """One pattern per line: no blanks around it, enclosing quotes or a comma dropped.

    Empty lines and lines starting with ``#`` are skipped.
    """
    kept = F.filter(F.split(content, "\n", -1), lambda line: is_pattern_line(line))
    bare = F.transform(F.transform(kept, trim_field), _bare_pattern)
    return F.filter(bare, lambda p: p != "")


def is_pattern_line(line: Column) -> Column:
    """Neither empty nor a comment."""
    return (line != "") & ~F.startswith(line, F.lit("#"))


def _bare_pattern(line: Column) -> Column:
    size = F.char_length(line)
    opened = F.startswith(line, F.lit('"')) & (size >= 2)
    closed_comma = F.endswith(line, F.lit('",')) & (size >= 3)
    return (
        F.when(opened & closed_comma, F.substring(line, F.lit(2), size - 3))
        .when(opened & F.endswith(line, F.lit('"')), F.substring(line, F.lit(2), size - 2))
        .when(F.endswith(line, F.lit(",")), F.substring(line, F.lit(1), size - 1))
        .otherwise(line)
    )


def loaded_patterns(content: Column) -> Column:
    """Quoted form; where it finds nothing at all, the line form."""
    quoted = quoted_patterns(content)
    return F.when(F.size(quoted) > 0, quoted).otherwise(line_patterns(content))


def strict_patterns(content: Column) -> Column:
    """Only lines that start with a quote and end with quote and comma."""
    lines = F.transform(F.split(content, "\n", -1), lambda line: F.btrim(line, F.lit(FIELD_BLANKS + "\f\u000b")))
    # A lone `",` both starts and ends the line; its slice is empty.
    strict = F.filter(lines, lambda line: F.startswith(line, F.lit('"')) & F.endswith(line, F.lit('",')))
    return F.transform(
        strict, lambda line: F.substring(line, F.lit(2), F.greatest(F.char_length(line) - 3, F.lit(0)))
    )


def weighted_pattern(line: Column) -> Column:
    """``pattern,weight`` split at the last comma; anything else gives null fields.

    Blanks around the pattern count; ``#,5`` is a pattern, ``# text`` is not.
    """
    line = F.regexp_replace(line, r"\r\z", "")
    weight = F.regexp_extract(line, WEIGHTED, 2)
    return F.when(
        weight != "",
        F.struct(F.regexp_extract(line, WEIGHTED, 1).alias("pattern"), weight.cast("int").alias("weight")),
    )


def scan_patterns(files: DataFrame, patterns: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, pid, pattern): pid is the position of the pattern in its file."""
    return files.select(*(keys or []), F.posexplode(patterns).alias("pid", "pattern"))


def scan_weighted_patterns(lines: DataFrame, line: str = "value") -> DataFrame:
    """All columns of ``lines`` plus pattern and weight; lines of another form drop out."""
    entry = weighted_pattern(F.col(line)).alias("entry")
    return (
        lines.select("*", entry)
        .where(F.col("entry").isNotNull())
        .select("*", "entry.pattern", "entry.weight")
        .drop("entry", line)
    )
