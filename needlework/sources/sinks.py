"""Writers for generated data sets and pattern files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_dataset(
    rows: DataFrame, path: str, dims: list[str], columns: tuple[str, ...] = ("query", "risk"), append: bool = False
) -> None:
    """CSV folders per ``dims``, minimal quoting with doubled quotes.

    Every file starts with a header line; the older appending form writes none.
    """
    out = rows.select(*dims, *columns).write.mode("append" if append else "overwrite").partitionBy(*dims)
    (
        out.option("header", not append)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_patterns(dictionary: DataFrame, path: str) -> None:
    """One quoted pattern and a comma per line, in order of pid."""
    lines = dictionary.orderBy("pid").select(F.format_string('"%s",', F.col("pattern")).alias("value"))
    lines.write.mode("overwrite").text(path)
