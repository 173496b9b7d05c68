"""Text clean-up expressions shared by the readers and the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
FIELD_BLANKS = " \t\r\n"


def normalize_query(text: Column) -> Column:
    """ASCII-only lower case: letters outside A-Z keep their bytes.

    ``lower`` alone is Unicode aware (the Kelvin sign becomes ``k``), so it may
    only see pure-ASCII rows, where it runs over bytes; the slower ``translate``
    handles the rest.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def trim_field(text: Column) -> Column:
    """Drop blanks, tabs, carriage returns and line feeds on both ends."""
    return F.btrim(text, F.lit(FIELD_BLANKS))


def strip_outer_quotes(text: Column) -> Column:
    """Remove one enclosing pair of double quotes, if there is one."""
    quoted = (F.char_length(text) >= 2) & F.startswith(text, F.lit('"')) & F.endswith(text, F.lit('"'))
    return F.when(quoted, F.substring(text, F.lit(2), F.char_length(text) - 2)).otherwise(text)


# Outside commas are marked with MARK before splitting.  Rows that already hold
# MARK (or the escape character) are escaped first, so any text survives.
MARK = "\u0001"
ESCAPE = "\u0002"


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "a")), F.lit(MARK), F.lit(ESCAPE + "b"))


def _unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "b"), F.lit(MARK)), F.lit(ESCAPE + "a"), F.lit(ESCAPE))


def toggle_fields(line: Column) -> Column:
    """Fields of a line where every ``"`` flips a quote flag and is dropped.

    A comma separates only while the flag is off.  This is not RFC 4180: a doubled
    quote inside a quoted field vanishes.  Splitting on the quote makes the
    pieces alternate between outside (even index) and inside (odd index).
    Linear in the line length, no regular expression.
    """
    pieces = F.transform(
        F.split(_escape(line), '"', -1),
        lambda piece, i: F.when(i % 2 == 0, F.replace(piece, F.lit(","), F.lit(MARK))).otherwise(piece),
    )
    fields = F.split(F.array_join(pieces, ""), MARK, -1)
    return F.transform(fields, _unescape)


def obfuscate_blanks(query: Column) -> Column:
    """Evasion form: every blank becomes an empty comment."""
    return F.replace(query, F.lit(" "), F.lit("/**/"))


def obfuscate_comment(query: Column) -> Column:
    """Evasion form: a trailing comment."""
    return F.concat(query, F.lit(" /* test */"))


def obfuscate_query(query: Column, variant: Column) -> Column:
    """Variant 0 is the query itself, 1 hides blanks, 2 adds a comment, 3 does both."""
    return (
        F.when(variant == 1, obfuscate_blanks(query))
        .when(variant == 2, obfuscate_comment(query))
        .when(variant == 3, obfuscate_comment(obfuscate_blanks(query)))
        .otherwise(query)
    )
