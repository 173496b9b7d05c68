"""Scores against labels: accuracy, confusion, agreement, previews.

A scored log has qid, query, normalized, expected and score; ``assess`` adds the
computed class and the match flag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needlework import fixed
from needlework.functions.hits import matched, occurrence_sum, weight_sum
from needlework.functions.risk import classify_risk, match_flag
from needlework.operators.dictionary import first_ids, merged_weights
from needlework.operators.matching import (
    distinct_score,
    occurrence_score,
    once,
    small_patterns,
    with_scores,
)

MODES = ["distinct", "occurrences", "first_id"]


def assess(scored: DataFrame, bounds: Sequence[int] = fixed.THRESHOLDS_V1) -> DataFrame:
    computed = scored.withColumn("computed", classify_risk(F.col("score"), bounds))
    return computed.withColumn("flag", match_flag(F.col("computed"), F.col("expected")))


def score_log(
    log: DataFrame,
    dictionary: DataFrame,
    mode: str = "distinct",
    bounds: Sequence[int] = fixed.THRESHOLDS_V1,
    key: str = "qid",
) -> DataFrame:
    """The log with score, computed class and flag, for one way of counting."""
    patterns = small_patterns(first_ids(dictionary) if mode == "first_id" else dictionary)
    score = distinct_score if mode == "distinct" else occurrence_score
    if patterns is not None:
        return assess(log.select("*", once(score=score(F.col("normalized"), patterns))), bounds)
    entries = first_ids(dictionary) if mode == "first_id" else merged_weights(dictionary)
    value = F.col("weight") if mode == "distinct" else F.col("weight") * F.col("hits")
    return assess(with_scores(log, entries, {"score": value}, key), bounds)


def score_log_all(
    log: DataFrame,
    dictionary: DataFrame,
    key: str = "qid",
    first_weights: DataFrame | None = None,
    first_bounds: Sequence[int] = fixed.THRESHOLDS_V1,
) -> DataFrame:
    """One row per query and way of counting (column ``algorithm``), from one scan.

    The ways differ only in what they add up, so the matches are found once.  The third
    way may have weights of its own, a dictionary of the same ids and patterns, and
    bounds of its own.
    """
    third = dictionary if first_weights is None else first_weights
    patterns, first = small_patterns(dictionary), small_patterns(first_ids(third))
    text, found = F.col("normalized"), F.col("found")
    if patterns is None or first is None:
        scored = _all_scores(log, dictionary, third, key)
    else:
        kept = F.filter(found, lambda p: p["pid"].isin([p.pid for p in first]))
        scores = [weight_sum(found), occurrence_sum(found, text), occurrence_sum(kept, text, first)]
        matches = log.select("*", matched(text, patterns).alias("found"))
        scored = matches.select(*log.columns, _runs(scores))
    computed = F.when(F.col("algorithm") == "first_id", classify_risk(F.col("score"), first_bounds)).otherwise(
        classify_risk(F.col("score"), fixed.THRESHOLDS_V1)
    )
    return scored.withColumn("computed", computed).withColumn("flag", match_flag(F.col("computed"), F.col("expected")))


def _runs(scores: list[Column]) -> Column:
    """Rows (algorithm, score), one per way of counting."""
    named = zip(MODES, scores, strict=True)
    return F.inline(F.array(*[F.struct(F.lit(m).alias("algorithm"), s.alias("score")) for m, s in named]))


def _all_scores(log: DataFrame, dictionary: DataFrame, third: DataFrame, key: str) -> DataFrame:
    """All ways of counting for a large dictionary: hits are found once, with both weights."""
    own = third.select(F.col("pid").alias("third_pid"), F.col("weight").alias("third"))
    both = dictionary.join(own, F.col("pid") == F.col("third_pid"))
    weight = F.struct(F.sum("weight").alias("all"), F.min_by("third", "pid").alias("first")).alias("weight")
    entries = both.groupBy("pattern").agg(F.min("pid").alias("pid"), weight)
    hits = F.col("hits")
    values = [F.col("weight.all"), F.col("weight.all") * hits, F.col("weight.first") * hits]
    names = [f"_{m}_score" for m in MODES]
    sums = with_scores(log, entries, dict(zip(names, values, strict=True)), key)
    return sums.select(*log.columns, _runs([F.col(n) for n in names]))


def _accuracy(correct: str = "correct", total: str = "total") -> Column:
    return F.when(F.col(total) > 0, F.lit(100.0) * F.col(correct) / F.col(total)).otherwise(F.lit(0.0))


def _share(part: str, total: str = "total") -> Column:
    return F.when(F.col(total) > 0, F.lit(100.0) * F.col(part) / F.col(total))


def run_counts() -> list[Column]:
    return [
        F.count("*").alias("total"),
        F.count_if(F.col("computed") == F.col("expected")).alias("correct"),
        F.count_if(F.col("score") == 0).alias("zero_scores"),
    ]


def accuracy(assessed: DataFrame) -> DataFrame:
    """total, correct, accuracy in percent (0 for an empty log)."""
    return assessed.agg(*run_counts()).select("total", "correct", _accuracy().alias("accuracy"))


def zero_score_share(assessed: DataFrame) -> DataFrame:
    """Queries without any hit and their share in percent (null for an empty log)."""
    return assessed.agg(*run_counts()).select("total", "zero_scores", _share("zero_scores").alias("zero_share"))


def score_stats(scored: DataFrame, by: str = "expected") -> DataFrame:
    return scored.groupBy(by).agg(
        F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("avg_score")
    )


def accuracy_matrix(assessed: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Accuracy and zero share per combination of ``dims``, with totals (rollup).

    One aggregation over all data sets; a data set without rows has no cell.  Total
    rows carry ``(all)``.
    """
    cells = assessed.rollup(*dims).agg(*run_counts(), F.grouping_id().alias("level"))
    names = [
        F.when(F.col("level").bitwiseAND(1 << (len(dims) - 1 - i)) != 0, "(all)").otherwise(F.col(d).cast("string")).alias(d)
        for i, d in enumerate(dims)
    ]
    return cells.select(
        *names,
        "total",
        "correct",
        _accuracy().alias("accuracy"),
        "zero_scores",
        _share("zero_scores").alias("zero_share"),
    )


def confusion_matrix(assessed: DataFrame) -> DataFrame:
    """Expected class by computed class, one column per computed class."""
    cells = assessed.groupBy("expected").pivot("computed", fixed.LABELS).agg(F.count(F.lit(1)))
    return cells.na.fill(0, fixed.LABELS)


def pattern_frequency(hits: DataFrame) -> DataFrame:
    """Hits per pattern over all texts; each text has at most one row per pattern."""
    return hits.groupBy("pid").agg(F.sum("hits").alias("hits"), F.count("*").alias("texts"))


def algorithm_agreement(log: DataFrame, dictionary: DataFrame, key: str = "qid") -> DataFrame:
    """Queries whose distinct and per-occurrence scores or classes differ.

    Both scores come from the same scan, whatever the size of the dictionary.
    """
    patterns = small_patterns(dictionary)
    if patterns is not None:
        text, found = F.col("normalized"), F.col("found")
        matches = log.select(key, text, matched(text, patterns).alias("found"))
        both = matches.select(
            key, once(distinct_score=weight_sum(found), occurrence_score=occurrence_sum(found, text))
        )
    else:
        values = {"distinct_score": F.col("weight"), "occurrence_score": F.col("weight") * F.col("hits")}
        scored = with_scores(log.select(key, "normalized"), merged_weights(dictionary), values, key)
        both = scored.select(key, *values)
    classed = both.withColumn("distinct_risk", classify_risk(F.col("distinct_score"))).withColumn(
        "occurrence_risk", classify_risk(F.col("occurrence_score"))
    )
    return classed.where(~F.col("distinct_score").eqNullSafe(F.col("occurrence_score")))


def filter_zero_score(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("score") == 0)


def filter_mismatch(assessed: DataFrame) -> DataFrame:
    return assessed.where(F.col("computed") != F.col("expected"))


def preview_queries(assessed: DataFrame, shown: int = 10, key: str = "qid") -> DataFrame:
    columns = [key, "query", "normalized", "score", "computed", "expected", "flag"]
    return assessed.select(*columns).orderBy(key).limit(shown)


def preview_per_class(scored: DataFrame, by: str, key: str, shown: int = 3) -> DataFrame:
    """The first rows per class.

    Spark limits each group inside every map task before the shuffle (window group
    limit), so one large class is no bottleneck.
    """
    rank = F.row_number().over(Window.partitionBy(by).orderBy(key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= shown)
