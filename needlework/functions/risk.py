"""Score -> risk class expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from needlework import fixed


def classify_risk(score: Column, bounds: Sequence[int] = fixed.THRESHOLDS_V1) -> Column:
    """Class of a score; each bound is the last score of its class."""
    low, medium, high = bounds
    return (
        F.when(score <= low, "low")
        .when(score <= medium, "medium")
        .when(score <= high, "high")
        .otherwise("critical")
    )


def risk_order(label: Column) -> Column:
    """0 for ``low`` up to 3 for ``critical``; null for anything else."""
    return F.nullif(F.array_position(F.array(*map(F.lit, fixed.LABELS)), label), F.lit(0)).cast("int") - 1


def nominal_score(label: Column) -> Column:
    """The score a label stands for in the older data sets."""
    entries = [F.lit(x) for pair in fixed.NOMINAL_SCORES.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), label)


def match_flag(computed: Column, expected: Column) -> Column:
    return F.when(computed == expected, "[OK]").otherwise("[Mismatch]")


def is_label(label: Column) -> Column:
    """Exactly one of the four labels, case-sensitive."""
    return label.isin(*fixed.LABELS)
