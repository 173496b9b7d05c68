"""Brute-force counterparts of the scan, used on small inputs only."""

from pyspark.sql import functions as F

from needlework.tables import literal_table


def occurrences(text, pattern):
    return [i for i in range(len(text) - len(pattern) + 1) if text[i : i + len(pattern)] == pattern]


def brute_distinct(text, entries):
    return sum(w for _, p, w in entries if p in text)


def brute_occurrences(text, entries):
    return sum(w * len(occurrences(text, p)) for _, p, w in entries)


def dictionary(spark, entries):
    rows = [{"pid": i, "pattern": p, "weight": w} for i, p, w in entries]
    return literal_table(spark, rows, "pid:bigint,pattern:string,weight:bigint")


def texts(spark, values):
    rows = [{"qid": i, "normalized": v} for i, v in enumerate(values)]
    return literal_table(spark, rows, "qid:bigint,normalized:string")


def lines(spark, values, name="value"):
    rows = [{"nr": i, name: v} for i, v in enumerate(values)]
    return literal_table(spark, rows, f"nr:int,{name}:string")


def single(spark, expression, **columns):
    """Value of one expression over one row of literals."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
    return row.select(expression.alias("x")).first()["x"]
