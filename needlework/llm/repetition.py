"""Repetition inside documents by suffix arrays over words.

The words of many documents are numbered, separately for each document, and laid end to
end, each closed by a number of its own, so that no common prefix leaves its document.  Prefix doubling sorts all
suffixes at once: the rank of the first ``2 * k`` words follows from the ranks of the
first ``k`` words at two places.  Suffixes whose rank is settled are not sorted again, so
only what repeats takes part in later rounds.  The kept ranks of every round also give the
longest common prefix of neighbours in the suffix order, by halving steps.

The longer of the two common prefixes of a suffix with its neighbours is the longest
repeat that starts there, so the union of these spans is the union of all maximal
repeated substrings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from needlework.llm.arrow import column, raw_texts, small_batches

SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(c for c in range(256) if c not in SYMBOLS)
WINDOW = 8
NAMES = "n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat"
JUDGED = (
    "doc_id bigint, "
    + ", ".join(f"{n} bigint" for n in NAMES.split(", "))
    + ", base_failed boolean, kept boolean"
)


@dataclass(frozen=True)
class Limits:
    """least_words: shortest document; repeat_percent: most words in repeated windows;
    least_repeat: words from which a repeat counts; covered_percent, longest: most words
    inside such repeats, and most words of a single one."""

    least_words: int = 20
    repeat_percent: int = 30
    least_repeat: int = 6
    covered_percent: int = 40
    longest: int = 200


def ranks_by_doubling(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix order of ``words``, and the ranks by the first 1, 2, 4, ... words.

    Equal ranks in round ``r`` mean equal first ``2**r`` words.  The rounds end when all
    ranks differ, which closing numbers guarantee.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    rank = grouped_ranks(words[order], order, np.arange(n))
    rounds, step = [rank], 1
    while True:
        # only suffixes that share their rank with another are sorted further
        same = rank[order[1:]] == rank[order[:-1]]
        shared = np.zeros(n, dtype=bool)
        shared[1:] = same
        shared[:-1] |= same
        places = np.flatnonzero(shared)
        if not len(places):
            return order, rounds
        items = order[places]
        ahead = items + step
        following = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = (rank[items].astype(np.int64) << 32) | following
        by = np.argsort(key, kind="stable")
        items, key = items[by], key[by]
        order = order.copy()
        order[places] = items
        new = rank.copy()
        new[items] = grouped_ranks(key, np.arange(len(items)), places)
        rank = new
        rounds.append(rank)
        step *= 2


def grouped_ranks(sorted_keys: np.ndarray, items: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Ranks of items in sorted order: the place of the first equal key."""
    first = np.empty(len(sorted_keys), dtype=bool)
    first[:1] = True
    first[1:] = sorted_keys[1:] != sorted_keys[:-1]
    rank = np.empty(len(sorted_keys), dtype=np.int64)
    rank[items] = places[np.flatnonzero(first)][np.cumsum(first) - 1]
    return rank


def common_prefixes(order: np.ndarray, rounds: list[np.ndarray]) -> np.ndarray:
    """Common words of each suffix in ``order`` with the one before it; the first has 0."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    length = np.zeros(max(n - 1, 0), dtype=np.int64)
    for r in range(len(rounds) - 1, -1, -1):
        rank = rounds[r]
        inside = np.flatnonzero((a < n) & (b < n))
        equal = inside[rank[a[inside]] == rank[b[inside]]]
        length[equal] += 1 << r
        a[equal] += 1 << r
        b[equal] += 1 << r
    return np.concatenate([[0], length])


def longest_repeats(words: np.ndarray) -> np.ndarray:
    """For each position the longest run of words that starts there and also elsewhere."""
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    order, rounds = ranks_by_doubling(words)
    prefix = common_prefixes(order, rounds)
    longest = np.empty(len(words), dtype=np.int64)
    longest[order] = np.maximum(prefix, np.append(prefix[1:], 0))
    return longest


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Marks the union of the spans on ``n`` places."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def judge(texts: list[bytes], limits: Limits) -> dict[str, np.ndarray]:
    """All columns but doc_id, for whole texts given as UTF-8."""
    number: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    counts = np.array([len(w) for w in split], dtype=np.int64)
    flat = [number.setdefault(w, len(number)) for words in split for w in words]
    # equal words of two documents get two numbers, and every document a closing one
    own = np.array(flat, dtype=np.int64) + np.repeat(np.arange(len(texts)) * len(number), counts)
    closing = np.cumsum(counts)
    words = np.insert(own, closing, -1 - np.arange(len(texts)))
    longest = longest_repeats(words)
    starts = closing - counts + np.arange(len(texts))
    doc = np.repeat(np.arange(len(texts)), counts + 1)

    def marked(least: int, length: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(longest >= least)
        inside = covered(at, at + length[at], len(words))
        return np.bincount(doc[inside], minlength=len(texts))

    out = {
        "n_words": counts,
        "word_chars": np.array([code_points(w) for w in split], dtype=np.int64),
        "n_symbols": np.array([len(t.translate(None, NOT_SYMBOLS)) for t in texts], dtype=np.int64),
        "n_dup_lines": np.array([repeated_lines(t) for t in texts], dtype=np.int64),
        "n_repeat_words": marked(WINDOW, np.full(len(words), WINDOW)),
        "covered_words": marked(limits.least_repeat, longest),
        "longest_repeat": np.maximum.reduceat(longest, starts) if len(texts) else counts,
    }
    failed = (counts < limits.least_words) | (100 * out["n_repeat_words"] > limits.repeat_percent * counts)
    over = (100 * out["covered_words"] > limits.covered_percent * counts) | (out["longest_repeat"] > limits.longest)
    return out | {"base_failed": failed, "kept": ~failed & ~over}


CONTINUATION = bytes(range(0x80, 0xC0))


def code_points(words: list[bytes]) -> int:
    return len(b"".join(words).translate(None, CONTINUATION))


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def repetition_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per document its counts, ``base_failed`` and ``kept``; see ``JUDGED``.

    ``kept`` is false if the base rules fail, if repeats of ``least_repeat`` words or more
    cover too many words, or if one repeat is too long.  A null or empty text has no words
    and fails; a null doc_id stays null, repeated rows are judged one by one, an empty
    table gives no rows, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = judge(raw_texts(batch), limits)
            columns = [column(batch, "doc_id").cast(pa.int64()), *map(pa.array, found.values())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *found])

    return docs.select("doc_id", "text").mapInArrow(run, JUDGED)
