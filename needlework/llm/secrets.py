"""Secrets in texts: fixed patterns, and windows of high entropy inside long strings.

A candidate is a run of characters that keys are made of.  Inside it a window of fixed
length slides over the characters of one class (hex digits, one case with digits, or
letters and digits of base 64); the counts in the window change by one character in and one out, and with them
the sum of ``c * log2(c)``, so every position costs constant time.  Windows whose Shannon
entropy reaches the class's bound are joined to spans.  What an allow-list explains is taken
out of the run first, and the windows slide over the rest of it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from needlework.llm.arrow import column, small_batches, texts

#: Fixed values of the base patterns: keyword assignments, access keys, runs of hex digits.
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_lower", "entropy_upper", "entropy_mixed")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


DIGIT = re.compile("[0-9]")


@dataclass(frozen=True)
class CharClass:
    """A kind of string: its characters, the window's length and the least bits per character.

    Each of ``needs`` must occur in the string.  Windows of a ``mixed`` class hold both
    cases and change between kinds of characters as often as random ones do.
    """

    kind: str
    characters: re.Pattern
    window: int
    bits: float
    needs: tuple[re.Pattern, ...] = ()
    mixed: bool = False


#: The bounds of the last three are passed by 99 % of random windows over 36, 32 and 64
#: characters.  A string of one case and hex digits only is left to the hex class.
CLASSES = (
    CharClass("entropy_hex", re.compile(r"[0-9a-f]{20,}|[0-9A-F]{20,}"), 20, 3.0),
    CharClass("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 4.1),
    CharClass("entropy_lower", re.compile(r"[a-z0-9]{20,}"), 20, 3.4, (re.compile("[g-z]"), re.compile("[0-9][^0-9]*[0-9]"))),
    CharClass("entropy_upper", re.compile(r"[A-Z0-9]{20,}"), 20, 3.34, (re.compile("[G-Z]"), DIGIT)),
    CharClass("entropy_mixed", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.64, mixed=True),
)
#: Changes between small letters, capitals, digits and signs in a mixed window, and in one without digits.
CHANGES, CHANGES_NO_DIGIT = 7, 9
_KIND_OF = np.full(128, 3, np.int8)
_KIND_OF[ord("a") : ord("z") + 1], _KIND_OF[ord("A") : ord("Z") + 1], _KIND_OF[ord("0") : ord("9") + 1] = 0, 1, 2
#: Parts of a run that look random but are none: identifiers, digests named as such, alphabets.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"(?i:0123456789|abcdefghij|klmnopqrst|qwertyuiop|example|placeholder|changeme)"),
    re.compile(r"^sha(?:1[-=_][0-9a-fA-F]{40}|256[-=_][0-9a-fA-F]{64}|512[-=_][0-9a-fA-F]{128})(?![A-Za-z0-9])"),
    re.compile(
        r"^sha(?:1[-=_][A-Za-z0-9+/_-]{27}=?|256[-=_][A-Za-z0-9+/_-]{43}=?|512[-=_][A-Za-z0-9+/_-]{86}(?:==)?)(?![A-Za-z0-9+/_=-])"
    ),
    re.compile(r"^(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_/](?:[A-Z]?[a-z]+|[A-Z]+))+$"),
)


def unexplained(run: str) -> list[tuple[int, int]]:
    """(start, end) of the parts of a run that no allow-list entry covers."""
    parts, at = [], 0
    for a, b in sorted(m.span() for each in ALLOWED for m in each.finditer(run)):
        if a > at:
            parts.append((at, a))
        at = max(at, b)
    return parts + [(at, len(run))] * (at < len(run))


def placed(parts: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """A span of the joined parts, as spans of the run they come from."""
    found, at = [], 0
    for a, b in parts:
        low, high = max(start, at), min(end, at + b - a)
        if low < high:
            found.append((a + low - at, a + high - at))
        at += b - a
    return found


def mixed_windows(text: str, window: int) -> np.ndarray:
    """Whether each window holds two letters of both cases and changes its kind of character often."""
    kinds = _KIND_OF[np.frombuffer(text.encode(), np.uint8)]

    def within(marked: np.ndarray, size: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marked)])
        return sums[size:] - sums[:-size]

    least = np.where(within(kinds == 2, window) > 0, CHANGES, CHANGES_NO_DIGIT)
    changes = within(kinds[1:] != kinds[:-1], window - 1)
    return (within(kinds == 0, window) >= 2) & (within(kinds == 1, window) >= 2) & (changes >= least)


def entropy_spans(text: str, window: int, least: float, open_to: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Joined windows of ``text`` with at least ``least`` bits per character, of those ``open_to`` marks if given."""
    counts: dict[str, int] = {}
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    total, spans = 0.0, []
    for at, came in enumerate(text):
        if at >= window:
            left = text[at - window]
            n = counts[left]
            counts[left] = n - 1
            total += term[n - 1] - term[n]
        n = counts.get(came, 0)
        counts[came] = n + 1
        total += term[n + 1] - term[n]
        start = at - window + 1
        if start >= 0 and math.log2(window) - total / window >= least - 1e-9 and (open_to is None or open_to[start]):
            if spans and start <= spans[-1][1]:
                spans[-1][1] = at + 1
            else:
                spans.append([start, at + 1])
    return [tuple(s) for s in spans]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind.

    A run of hex digits matches whole or not at all, and so does an access key, so
    their least lengths may stand in the pattern.  An assignment is found first and
    measured then, because a short one hides what it covers.
    """
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(start, KINDS[kind], end) for start, kind, end in sorted(found)]


def random_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of windows of high entropy in what the allow-list leaves of each run."""
    found = []
    for m in CANDIDATE.finditer(text):
        parts = unexplained(m.group())
        rest = "".join(m.group()[a:b] for a, b in parts)
        for each in CLASSES:
            if not each.mixed and not DIGIT.search(m.group()):
                continue
            for part in each.characters.finditer(rest):
                run = part.group()
                if not all(need.search(run) for need in each.needs):
                    continue
                open_to = mixed_windows(run, each.window) if each.mixed else None
                if open_to is not None and not open_to.any():
                    continue
                for a, b in entropy_spans(run, each.window, each.bits, open_to):
                    spans = placed(parts, part.start() + a, part.start() + b)
                    found += [(m.start() + low, each.kind, m.start() + high) for low, high in spans]
    return sorted(found)


def joined(spans: list[tuple[int, str, int]]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in order)


FOUND = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, base_sha256 string, spans string"


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document the number of spans of each kind, a digest of the fixed patterns' and all spans.

    Positions are code points, ends exclusive.  A null or empty text has no spans, and its
    digest is that of the empty string; a null doc_id stays null, repeated rows are
    searched one by one, an empty table gives no rows, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for text in texts(batch):
                base, more = base_spans(text), random_spans(text)
                kinds = [k for _, k, _ in base]
                rows.append(
                    (
                        *[kinds.count(k) for k in KINDS[:3]],
                        len(more),
                        hashlib.sha256(joined(base).encode()).hexdigest(),
                        joined(base + more),
                    )
                )
            names = [c.split()[0] for c in FOUND.split(", ")]
            columns = [column(batch, "doc_id").cast(pa.int64()), *map(pa.array, zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def redacted(text: str, mark: str) -> str:
    """The text with every found span, or joined overlapping spans, replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in sorted(base_spans(text) + random_spans(text)):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]]) if out else text


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with secrets replaced in ``text`` and ``n_chars`` counted again if it changed.

    Every row and column stays; null texts stay null.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            old = column(batch, "text").to_pylist()
            new = [t and redacted(t, mark) for t in old]
            columns = {n: batch.column(i) for i, n in enumerate(names)}
            columns["text"] = pa.array(new, batch.schema.field("text").type)
            if "n_chars" in columns:
                counts = columns["n_chars"].to_pylist()
                counts = [c if a == b else len(b) for c, a, b in zip(counts, old, new, strict=True)]
                columns["n_chars"] = pa.array(counts, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(run, docs.schema)
