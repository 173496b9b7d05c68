"""Scan inputs derived from the given tables.

The tables hold no attack strings and no labelled log, so texts get payloads planted
and every event stands for one logged query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needlework import fixed
from needlework.functions.text import normalize_query
from needlework.operators import corpus
from needlework.tables import spread

# Besides the templates: repeated, overlapping and comma-newline texts.
EXTRA_PAYLOADS = ["a,\nb", "-----", "-- --", "= = ="]
PAYLOADS = [t for risk in fixed.LABELS for t in fixed.TEMPLATES[risk]] + EXTRA_PAYLOADS
CYCLE = 61  # three more slots than payloads, so some texts stay as they are

HEADER = "Algorithm,Dataset_Size,Pattern_Count,Execution_Time_μs,Risk_Level"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def plant(docs: DataFrame) -> DataFrame:
    planted = corpus.inject_payloads(docs, "doc_id", "text", PAYLOADS, CYCLE)
    return planted.select("doc_id", normalize_query(F.col("text")).alias("normalized"))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, normalized): every document, most with a payload appended."""
    return plant(documents(spark, sf_dir))


def label_events(events: DataFrame) -> DataFrame:
    rows = events.select(F.col("event_id").alias("qid"), "ts", F.col("event_type").alias("dataset"))
    labelled = corpus.label_rows(rows, "qid")
    return labelled.select(
        "qid",
        "ts",
        "dataset",
        F.col("template").alias("query"),
        normalize_query(F.col("template")).alias("normalized"),
        F.col("risk").alias("expected"),
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, ts, dataset, query, normalized, expected): one query per event."""
    return label_events(spread(table(spark, sf_dir, "events").select("event_id", "ts", "event_type")))


def loose_labels(log: DataFrame) -> DataFrame:
    """Labels as a hand-kept log has them: some in capitals, some with blanks around."""
    loose = (
        F.when(F.col("dataset") == "error", F.upper("expected"))
        .when(F.col("dataset") == "signup", F.concat(F.lit("\t"), F.col("expected"), F.lit(" ")))
        .otherwise(F.col("expected"))
    )
    return log.withColumn("label", loose)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, value): the log as CSV lines, with empty and one-field lines among them."""
    log = loose_labels(query_log(spark, sf_dir))
    needs_quotes = F.contains("query", F.lit('"')) | F.contains("query", F.lit(","))
    quoted = F.concat(F.lit('"'), F.replace(F.col("query"), F.lit('"'), F.lit('""')), F.lit('"'))
    field = F.when(needs_quotes, quoted).otherwise(F.col("query"))
    line = (
        F.when(F.col("qid") % 97 == 0, "")
        .when(F.col("qid") % 89 == 0, field)
        .when(F.col("qid") % 2 == 0, F.concat_ws(",", field, "label"))
        .otherwise(F.concat_ws(",", field, "label", F.lit("10")))
    )
    return log.select("qid", line.alias("value"))


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def quoted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, value): one pattern file per message, a quoted word per line.

    Odd turns open with a pattern that starts with a quote.
    """
    words = F.concat(F.lit('"'), F.replace(F.col("text"), F.lit(" "), F.lit('",\n"')), F.lit('",\n'))
    value = F.when(F.col("turn") % 2 == 1, F.concat(F.lit('"" or",\n'), words)).otherwise(words)
    return _talks(spark, sf_dir).select("conv_id", "turn", value.alias("value"))


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unquoted pattern files for odd turns, quoted ones for the others."""
    plain = F.concat(
        F.lit("# "), F.col("role"), F.lit("\n\n"), F.replace(F.col("text"), F.lit(" "), F.lit(" ,\n ")), F.lit('"\n')
    )
    quoted = F.concat(F.lit('"'), F.replace(F.col("text"), F.lit(" "), F.lit('",\n"')), F.lit('"'))
    value = F.when(F.col("turn") % 2 == 1, plain).otherwise(quoted)
    return _talks(spark, sf_dir).select("conv_id", "turn", value.alias("value"))


def weighted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, nr, value): ``word,weight`` lines after a comment and an empty line."""
    lines = F.split(
        F.concat(F.lit("# "), F.col("role"), F.lit("\n\n"), F.replace(F.col("text"), F.lit(" "), F.lit(",10\n"))),
        "\n",
        -1,
    )
    return _talks(spark, sf_dir).select("conv_id", "turn", F.posexplode(lines).alias("nr", "value"))


def part_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, pattern, weight): name, type and name with brand of every part.

    Grows with the table; many texts repeat and many contain others.
    """
    part = table(spark, sf_dir, "part")
    texts = F.array("p_name", "p_type", F.concat_ws(" ", "p_name", "p_brand"))
    rows = part.select("p_partkey", F.posexplode(texts).alias("nr", "text"))
    pid = (F.col("p_partkey") * 3 + F.col("nr")).alias("pid")
    return rows.select(pid, normalize_query(F.col("text")).alias("pattern"), F.lit(1).cast("bigint").alias("weight"))


def log_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, pattern): the logged queries taken as patterns; some equal a needle.

    Every fourth event stands for a needle, so that exact look-ups find something.
    """
    needles = F.array(*map(F.lit, fixed.pattern_lines()))
    needle = F.get(needles, F.pmod(F.col("qid"), F.size(needles)).cast("int"))
    text = F.when(F.col("qid") % 4 == 0, needle).otherwise(F.col("normalized"))
    return query_log(spark, sf_dir).select(F.col("qid").alias("pid"), text.alias("pattern"))


def word_dictionary(spark: SparkSession, sf_dir: str, least: int = 1) -> DataFrame:
    """(pid, pattern, weight): the distinct words of ``least`` letters or more in the messages.

    Thousands of patterns even on small tables.  The pid is taken from the hash of the
    word, so no global numbering is needed.
    """
    words = F.explode(F.regexp_extract_all(normalize_query(F.col("text")), F.lit(f"[a-z]{{{least},}}"), F.lit(0)))
    distinct = _talks(spark, sf_dir).select(words.alias("pattern")).distinct()
    return distinct.select(
        F.conv(F.substring(F.md5("pattern"), F.lit(1), F.lit(15)), 16, 10).cast("bigint").alias("pid"),
        "pattern",
        (F.char_length("pattern") % 5 + 1).cast("bigint").alias("weight"),
    )


def timing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nr, value): one line of a timing table per event, with blank and header lines."""
    events = table(spark, sf_dir, "events")
    ms = F.floor(F.col("value") * 1000)
    labels = F.array(*map(F.lit, fixed.LABELS))
    line = F.concat_ws(
        ",",
        F.when(F.col("event_id") % 2 == 0, "distinct").otherwise("occurrences"),
        ((F.col("user_id") * 37 + F.col("event_id")) % 9991 + 10).cast("string"),
        F.lit("72"),
        F.concat_ws(".", F.floor(ms / 1000).cast("string"), F.lpad((ms % 1000).cast("string"), 3, "0")),
        F.get(labels, (F.col("event_id") % 4).cast("int")),
    )
    value = F.when(F.col("event_id") % 53 == 0, "").when(F.col("event_id") % 59 == 0, HEADER).otherwise(line)
    return events.select(F.col("event_id").alias("nr"), value.alias("value"))
