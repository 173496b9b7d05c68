"""The weighted dictionary: weights, statistics, duplicates, implications.

A dictionary is a DataFrame (pid BIGINT, pattern STRING, weight BIGINT); pid is the
position in the pattern file.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needlework import fixed
from needlework.functions.text import normalize_query
from needlework.sources.patterns import loaded_patterns, scan_patterns
from needlework.tables import literal_table


def _first_rule(pattern: Column, rules: list[tuple[int, list[str]]], default: int) -> Column:
    """Weight of the first rule with a needle inside the pattern."""
    literal = json.dumps([{"weight": weight, "needles": needles} for weight, needles in rules])
    table = F.from_json(F.lit(literal), "array<struct<weight:bigint,needles:array<string>>>")
    hit = F.filter(table, lambda rule: F.exists(rule["needles"], lambda needle: F.contains(pattern, needle)))
    weight = F.coalesce(F.get(hit, F.lit(0))["weight"], F.lit(default).cast("bigint"))
    # A second reference outside the lambda keeps Catalyst from repeating a costly
    # upstream expression once per needle.
    return F.when(pattern.isNotNull(), weight)


def tiered_weight(pattern: Column, default: int = fixed.DEFAULT_WEIGHT) -> Column:
    """Weight by the ordered tiers; ``default`` where no tier applies."""
    return _first_rule(pattern, fixed.WEIGHT_TIERS, default)


def simple_weight(pattern: Column) -> Column:
    """Weight by the short rule."""
    return _first_rule(pattern, fixed.SIMPLE_WEIGHTS, fixed.SIMPLE_DEFAULT_WEIGHT)


def weight_rules(spark: SparkSession) -> DataFrame:
    """(pattern, weight): the 72 needles with their tier weight."""
    rows = [{"pattern": n, "weight": w} for w, needles in fixed.WEIGHT_TIERS for n in needles]
    return literal_table(spark, rows, "pattern:string,weight:bigint")


def weight_lookup(patterns: DataFrame) -> DataFrame:
    """Weight of patterns equal to one of the needles; 0 for all others.

    The rule table has 72 rows, whatever the data size, so it is broadcast.
    """
    rules = F.broadcast(weight_rules(patterns.sparkSession))
    return patterns.join(rules, "pattern", "left").withColumn("weight", F.coalesce("weight", F.lit(0).cast("bigint")))


def load_dictionary(files: DataFrame, weight=tiered_weight) -> DataFrame:
    """Dictionary of a pattern file (one row, column ``value``)."""
    found = scan_patterns(files, loaded_patterns(F.col("value")))
    normalized = found.select(F.col("pid").cast("bigint").alias("pid"), normalize_query(F.col("pattern")).alias("pattern"))
    return normalized.withColumn("weight", weight(F.col("pattern")))


def standard_dictionary(spark: SparkSession, weight=tiered_weight) -> DataFrame:
    """The 73 patterns the scanners extract from the standard pattern file."""
    files = literal_table(spark, [{"value": fixed.pattern_file_text()}], "value:string")
    return load_dictionary(files, weight)


def plain_dictionary(spark: SparkSession) -> DataFrame:
    """The 72 needles as written, as the generator scores them."""
    rows = [
        {"pid": i, "pattern": n, "weight": w}
        for i, (n, w) in enumerate((n, w) for w, needles in fixed.WEIGHT_TIERS for n in needles)
    ]
    return literal_table(spark, rows, "pid:bigint,pattern:string,weight:bigint")


def trie_stats(dictionary: DataFrame) -> DataFrame:
    """Size of the prefix tree: one node per distinct prefix, plus the root."""
    prefixes = dictionary.where(F.col("pattern") != "").select(
        "pattern", F.explode(F.sequence(F.lit(1), F.char_length("pattern"))).alias("n")
    )
    counted = prefixes.select("n", F.substring("pattern", F.lit(1), F.col("n")).alias("prefix")).agg(
        F.count_distinct("prefix").alias("transitions"), F.count_if(F.col("n") == 1).alias("patterns")
    )
    return counted.select(
        "patterns",
        (F.col("transitions") + 1).alias("nodes"),
        "transitions",
        (F.col("transitions") / (F.col("transitions") + 1)).alias("transitions_per_node"),
    )


def limits(
    dictionary: DataFrame, max_nodes: int = fixed.MAX_NODES, max_patterns: int = fixed.MAX_PATTERNS
) -> DataFrame:
    """Would the dictionary fit the fixed-size tables of the original scanners?"""
    return trie_stats(dictionary).select(
        "patterns",
        "nodes",
        (F.col("nodes") <= max_nodes).alias("nodes_fit"),
        (F.col("patterns") <= max_patterns).alias("patterns_fit"),
    )


def first_ids(dictionary: DataFrame) -> DataFrame:
    """One entry per text: the lowest pid and its weight."""
    first = F.min_by(F.struct("pid", "weight"), F.col("pid")).alias("first")
    return dictionary.groupBy("pattern").agg(first).select("first.pid", "pattern", "first.weight")


def merged_weights(dictionary: DataFrame) -> DataFrame:
    """One entry per text with the weights of all its ids added up.

    All ids of a text are found together, so sums over matches stay the same while a
    text filed many times takes part in the scan once.
    """
    return dictionary.groupBy("pattern").agg(F.min("pid").alias("pid"), F.sum("weight").alias("weight")).select(
        "pid", "pattern", "weight"
    )


def duplicates(dictionary: DataFrame) -> DataFrame:
    """Texts filed more than once.

    Counts and end points only: a text may have any number of ids, and those stay in
    the rows of the dictionary.
    """
    return (
        dictionary.groupBy("pattern")
        .agg(
            F.min("pid").alias("first_pid"),
            F.max("pid").alias("last_pid"),
            F.count("*").alias("copies"),
        )
        .where(F.col("copies") > 1)
    )


def preview(dictionary: DataFrame, shown: int = 10) -> DataFrame:
    """The first patterns, numbered, and how many more there are."""
    numbered = dictionary.orderBy("pid").limit(shown).select(
        F.row_number().over(Window.orderBy("pid")).alias("line"), F.col("pattern").alias("shown")
    )
    rest = dictionary.agg(F.count("*").alias("n")).where(F.col("n") > shown)
    more = rest.select(
        F.lit(shown + 1).alias("line"),
        F.format_string("... and %d more patterns", F.col("n") - shown).alias("shown"),
    )
    return numbered.unionByName(more)


def weight_distribution(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("weight").agg(F.count("*").alias("patterns"))
