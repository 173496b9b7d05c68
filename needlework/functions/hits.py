"""Which patterns occur in a text, as one narrow column expression.

Meant for dictionaries of a checked, small size (see ``EXPRESSION_PATTERNS``): the
patterns become a constant array, so a scan needs no join, no shuffle and no
broadcast, and works the same on a stream.

Testing every pattern against every text is mostly wasted work.  Patterns are
therefore filed under a *gate*: a piece of text several patterns contain.  A text
without the gate cannot hold any of them, so one test rules the whole group out.
"""

from __future__ import annotations

import json
from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

EXPRESSION_PATTERNS = 256
GATE_CHARS = 4
OWN_GATE_CHARS = 3
COMMON = " etaoinshrdlucmfwypvbgkjqxz"  # blanks and letters by how often prose has them


class Pattern(NamedTuple):
    pid: int
    pattern: str
    weight: int


def overlap_regex(pattern: str) -> str | None:
    """A look-ahead that matches at every start, or None if starts cannot overlap.

    Occurrences overlap only if a proper prefix of the pattern is also its suffix.
    """
    if not any(pattern[:n] == pattern[-n:] for n in range(1, len(pattern))):
        return None
    return "(?=" + quote_regex(pattern) + ")"


def quote_regex(pattern: str) -> str:
    return "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def gate_groups(patterns: list[Pattern]) -> list[tuple[str, list[Pattern]]]:
    """File every pattern under the gate shared by most patterns still unfiled.

    Gates are single characters that are rare in prose (neither letters, digits nor
    blanks) or pieces of ``GATE_CHARS`` characters.  A pattern sharing nothing gets a
    gate of its own, the rest of it from its rarest character on: looking for a text
    costs most where its first character is frequent.
    """
    gates = {p: _gates(p.pattern) for p in patterns}
    unfiled = list(patterns)
    groups = []
    while unfiled:
        shared = Counter(gate for p in unfiled for gate in gates[p])
        gate, size = min(shared.items(), key=lambda g: (-g[1], _commonness(g[0]), g[0]), default=("", 0))
        if size < 2:
            break
        groups.append((gate, [p for p in unfiled if gate in gates[p]]))
        unfiled = [p for p in unfiled if gate not in gates[p]]
    return groups + [(_own_gate(p.pattern), [p]) for p in unfiled]


def _commonness(gate: str) -> int:
    """0 if the gate starts with no common character, else the higher the more common."""
    return len(COMMON) - COMMON.index(gate[0]) if gate[0] in COMMON else 0


def _own_gate(pattern: str) -> str:
    starts = range(max(len(pattern) - OWN_GATE_CHARS + 1, 1))
    return min((pattern[i:] for i in starts), key=_commonness)


def _gates(pattern: str) -> set[str]:
    rare = {c for c in pattern if not c.isalnum() and not c.isspace()}
    return rare | {pattern[i : i + GATE_CHARS] for i in range(len(pattern) - GATE_CHARS + 1)}


PATTERN_TYPE = "struct<pid:bigint,pattern:string,weight:bigint,overlap:string>"
GROUPS_TYPE = f"array<struct<gate:string,patterns:array<{PATTERN_TYPE}>>>"


def _groups(patterns: list[Pattern]) -> Column:
    """The filed dictionary as a constant.

    Passed as one JSON literal, which the optimizer folds: building it from nested
    ``struct`` calls costs seconds of plan analysis per query.
    """
    groups = [
        {"gate": gate, "patterns": [{**p._asdict(), "overlap": overlap_regex(p.pattern)} for p in members]}
        for gate, members in gate_groups(patterns)
    ]
    return F.from_json(F.lit(json.dumps(groups)), GROUPS_TYPE)


def matched(text: Column, patterns: list[Pattern]) -> Column:
    """Array of the dictionary entries found in ``text``, in no particular order.

    ``text`` is referenced twice on purpose: Catalyst then keeps a costly
    upstream expression in its own projection instead of repeating it per gate.
    """
    open_groups = F.filter(_groups(patterns), lambda g: F.contains(text, g["gate"]))
    return F.flatten(
        F.transform(open_groups, lambda g: F.filter(g["patterns"], lambda p: F.contains(text, p["pattern"])))
    )


def any_matched(text: Column, patterns: list[Pattern]) -> Column:
    """Whether at least one dictionary entry occurs; stops at the first one."""
    return F.exists(
        _groups(patterns),
        lambda g: F.contains(text, g["gate"]) & F.exists(g["patterns"], lambda p: F.contains(text, p["pattern"])),
    )


def occurrences(text: Column, pattern: Column, overlap: Column) -> Column:
    """Number of start positions of a pattern known to occur, overlaps included."""
    removed = F.char_length(text) - F.char_length(F.replace(text, pattern, F.lit("")))
    return F.when(
        overlap.isNull(), (removed / F.char_length(pattern)).cast("bigint")
    ).otherwise(F.size(F.regexp_extract_all(text, overlap, F.lit(0))).cast("bigint"))


def weight_sum(matches: Column) -> Column:
    """Distinct-pattern score of a ``matched`` array."""
    return F.aggregate(matches, F.lit(0).cast("bigint"), lambda acc, p: acc + p["weight"])


def occurrence_sum(matches: Column, text: Column, weights: list[Pattern] | None = None) -> Column:
    """Per-occurrence score of a ``matched`` array, with its own weights or those of ``weights``."""
    if weights is None:
        weight = lambda p: p["weight"]
    else:
        table = F.from_json(F.lit(json.dumps({str(p.pid): p.weight for p in weights})), "map<string,bigint>")
        weight = lambda p: F.element_at(table, p["pid"].cast("string"))
    return F.aggregate(
        matches,
        F.lit(0).cast("bigint"),
        lambda acc, p: acc + weight(p) * occurrences(text, p["pattern"], p["overlap"]),
    )
