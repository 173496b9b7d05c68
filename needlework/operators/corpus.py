"""Labelled test corpora as Spark jobs.

Random choices are replaced by a key of the input row (its id modulo the number of
choices), so every run gives the same rows and any partitioning gives the same result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from needlework import fixed
from needlework.functions.risk import nominal_score
from needlework.functions.text import normalize_query, obfuscate_query
from needlework.operators.dictionary import plain_dictionary
from needlework.operators.matching import distinct_score, small_patterns
from needlework.tables import literal_table

ROWS_PER_TASK_ROW = 10_000


def template_catalog(spark: SparkSession) -> DataFrame:
    """(tid, risk, idx, template): all templates, numbered overall and per class."""
    listed = [(risk, i, t) for risk in fixed.LABELS for i, t in enumerate(fixed.TEMPLATES[risk])]
    rows = [{"tid": tid, "risk": r, "idx": i, "template": t} for tid, (r, i, t) in enumerate(listed)]
    return literal_table(spark, rows, "tid:int,risk:string,idx:int,template:string")


def n_templates() -> int:
    return sum(len(t) for t in fixed.TEMPLATES.values())


def _by_class(table: dict) -> Column:
    """A constant map from class to a value list or count."""
    values = next(iter(table.values()))
    kind = "array<string>" if isinstance(values, list) else "int"
    return F.from_json(F.lit(json.dumps(table)), f"map<string,{kind}>")


def _pick(table: dict, risk: Column, key: Column) -> Column:
    choices = F.element_at(_by_class(table), risk)
    return F.get(choices, F.pmod(key, F.size(choices)).cast("int"))


def label_rows(rows: DataFrame, key: str) -> DataFrame:
    """Every row gets one template (key modulo catalog size) and its class."""
    catalog = F.broadcast(template_catalog(rows.sparkSession))  # fixed size
    return rows.withColumn("tid", F.pmod(F.col(key), F.lit(n_templates())).cast("int")).join(catalog, "tid")


def sample_templates(keys: DataFrame, key: str) -> DataFrame:
    """Every row of ``keys`` once per class, with a template of that class."""
    sizes = _by_class({risk: len(t) for risk, t in fixed.TEMPLATES.items()})
    rows = keys.select("*", F.explode(F.array(*map(F.lit, fixed.LABELS))).alias("risk"))
    indexed = rows.withColumn("idx", F.pmod(F.col(key), F.element_at(sizes, F.col("risk"))).cast("int"))
    catalog = F.broadcast(template_catalog(keys.sparkSession).select("risk", "idx", "template"))
    return indexed.join(catalog, ["risk", "idx"])


def adjust_to_target(rows: DataFrame, key: str, query: str = "template", risk: str = "risk") -> DataFrame:
    """Adds final_query and score, moved into the score range of the class if possible.

    Too low: an addition is appended.  Too high: a simpler query takes its place.
    Either change is kept only if its score falls into the range.
    """
    patterns = small_patterns(plain_dictionary(rows.sparkSession))
    bounds = {r: list(map(str, b)) for r, b in fixed.TARGET_RANGES.items()}
    low, high = (
        F.get(F.element_at(_by_class(bounds), F.col(risk)), F.lit(i)).cast("bigint") for i in (0, 1)
    )
    longer = F.concat(F.col(query), _pick(fixed.ADDITIONS, F.col(risk), F.col(key)))
    simpler = _pick(fixed.REPLACEMENTS, F.col(risk), F.col(key))
    candidates = rows.select(
        "*",
        low.alias("_low"),
        high.alias("_high"),
        longer.alias("_longer"),
        simpler.alias("_simpler"),
    )
    texts = {"_own": query, "_longer": "_longer", "_simpler": "_simpler"}
    folded = candidates.select("*", *[normalize_query(F.col(c)).alias(f"{n}_text") for n, c in texts.items()])

    def score(name: str) -> Column:
        return distinct_score(F.col(f"{name}_text"), patterns)

    # Each alternative is scored only for the rows that may need it.
    own = F.col("_own_score")
    scored = folded.select("*", score("_own").alias("_own_score")).select(
        "*",
        F.when(own < F.col("_low"), score("_longer")).alias("_longer_score"),
        F.when(own > F.col("_high"), score("_simpler")).alias("_simpler_score"),
    )

    def fits(name: str) -> Column:
        return F.coalesce(F.col(name).between(F.col("_low"), F.col("_high")), F.lit(False))

    use_longer, use_simpler = fits("_longer_score"), fits("_simpler_score")

    def chosen(longer: str, simpler: str, own: str) -> Column:
        return F.when(use_longer, F.col(longer)).when(use_simpler, F.col(simpler)).otherwise(F.col(own))

    return scored.select(
        *rows.columns,
        chosen("_longer", "_simpler", query).alias("final_query"),
        chosen("_longer_score", "_simpler_score", "_own_score").alias("score"),
    )


def generate_dataset(keys: DataFrame, key: str) -> DataFrame:
    """Every row of ``keys`` once per class, with risk, query and score.

    The outcome depends only on class, template and choice, so those few combinations
    are scored once and broadcast (their number is fixed by the catalog); the rows
    themselves pass through one hash lookup.
    """
    spark = keys.sparkSession
    choices = {r: len(fixed.ADDITIONS[r]) for r in fixed.LABELS}
    if choices != {r: len(fixed.REPLACEMENTS[r]) for r in fixed.LABELS}:
        raise ValueError("additions and replacements of a class must be equally many")
    per_class = _by_class(choices)
    combinations = template_catalog(spark).withColumn(
        "choice", F.explode(F.sequence(F.lit(0), F.element_at(per_class, F.col("risk")) - 1))
    )
    outcomes = adjust_to_target(combinations, "choice").select("risk", "idx", "choice", "final_query", "score")
    sampled = sample_templates(keys, key).withColumn(
        "choice", F.pmod(F.col(key), F.element_at(per_class, F.col("risk"))).cast("int")
    )
    made = sampled.join(F.broadcast(outcomes), ["risk", "idx", "choice"])
    return made.select(*keys.columns, "risk", F.col("final_query").alias("query"), "score")


def generate_matrix(sizes: DataFrame, name: str = "dataset", size: str = "size") -> DataFrame:
    """Data sets of the given sizes for all classes: (name, row, risk, query, score).

    A size is first cut into blocks, the blocks are spread over the cluster, and only
    then become rows, so one very large data set does not come out of one task.
    """
    blocks = sizes.where(F.col(size) > 0).select(
        name, size, F.explode(F.sequence(F.lit(0), F.col(size) - 1, F.lit(ROWS_PER_TASK_ROW))).alias("first")
    )
    last = F.least(F.col("first") + ROWS_PER_TASK_ROW, F.col(size)) - 1
    rows = blocks.repartition(name, "first").select(name, F.explode(F.sequence(F.col("first"), last)).alias("row"))
    return generate_dataset(rows, "row")


def generate_variations(base: DataFrame, variants: int = 3, query: str = "query", risk: str = "risk") -> DataFrame:
    """Every query once as it is and ``variants`` times in evasion forms.

    Adds variant, variation and the nominal score of the class.
    """
    rows = base.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants))))
    return rows.withColumn("variation", obfuscate_query(F.col(query), F.pmod("variant", F.lit(4)))).withColumn(
        "score", nominal_score(F.col(risk))
    )


def inject_payloads(texts: DataFrame, key: str, text: str, payloads: list[str], cycle: int) -> DataFrame:
    """Appends payload ``key mod cycle`` to a text; numbers beyond the list leave it alone."""
    table = [{"slot": i, "payload": p} for i, p in enumerate(payloads)]
    slots = F.broadcast(literal_table(texts.sparkSession, table, "slot:int,payload:string"))
    slot = F.pmod(F.col(key), F.lit(cycle)).cast("int")
    joined = texts.withColumn("slot", slot).join(slots, "slot", "left")
    planted = F.when(F.col("payload").isNull(), F.col(text)).otherwise(F.concat_ws(" ", F.col(text), F.col("payload")))
    return joined.withColumn(text, planted).drop("slot", "payload")
