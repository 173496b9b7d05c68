"""Small tables with the awkward rows every operator must stand."""

import pytest

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size string, fingerprint int"
PROSE = "The quick brown fox jumps over the lazy dog near the river bank. It was a fine day, and all was well! "


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    texts = [None, "", " \n\t", PROSE, PROSE, PROSE * 400, "Ünïcode ßtraße 日本語 😀 text", "x" * 5000, "a b c", "token = abcdef123"]
    rows = [(i, t, "en", "s", 1, 0.5, "big", 7) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (3, "another text with the same id", None, None, None, None, None, None)]
    rows += [(None, PROSE, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, FIELDS).repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], FIELDS)


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
