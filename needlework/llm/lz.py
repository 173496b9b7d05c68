"""Lempel-Ziv phrase fingerprints.

A text is parsed from its start into the shortest phrases not met before (LZ78).  Texts
that share passages share phrases, much as they would compress well together.  Phrases
are hashed by a polynomial over their code points, and the ``SIZE`` smallest hashes of the
set are the signature.  Among the smallest hashes of the union of two sets, the share
that lies in both estimates the sets' likeness, and is exact for short texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needlework.llm.arrow import column, small_batches, texts

SIZE = 64
BASE = np.uint64(0x9E3779B97F4A7C15)
#: The base's inverse modulo 2**64.
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def parse(text: str, at: int, nodes: dict[tuple[int, str], int], ends: list[int]) -> int:
    """Adds the phrases from ``at`` on to ``nodes`` and their ends to ``ends``.

    A phrase is a node, found by the phrase without its last character and that character;
    nodes are numbered as they come, 0 is the empty phrase.  Returns where the last phrase
    begins that the text's end leaves incomplete.
    """
    put, add, new, node = nodes.setdefault, ends.append, len(nodes) + 1, 0
    for end, character in enumerate(text[at:] if at else text, at + 1):
        node = put((node, character), new)
        if node == new:
            new += 1
            node = 0
            add(end)
    return max(at, ends[-1]) if ends else at


class Powers:
    """Powers of the base and its inverse, as long as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, BASE)]))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, INVERSE)]))
        return self.up, self.down


POWERS = Powers()


def signature(text: str, ends: list[int]) -> np.ndarray:
    """The smallest 32-bit hashes of the phrases that end at ``ends``, in order."""
    if not ends:
        return np.zeros(0, dtype=np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    up, down = POWERS.upto(len(points))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(points * down[: len(points)])])
    stop = np.array(ends)
    start = np.concatenate([[0], stop[:-1]])
    mixed = (sums[stop] - sums[start]) * up[start]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    hashes = (mixed >> np.uint64(32)).astype(np.uint32)
    if len(hashes) > 8 * SIZE:
        hashes = hashes[hashes <= np.partition(hashes, 2 * SIZE)[2 * SIZE]]
    return np.unique(hashes)[:SIZE]


def fingerprint(text: str) -> np.ndarray:
    ends: list[int] = []
    parse(text, 0, {}, ends)
    return signature(text, ends)


def edited_text(text: str, following: str) -> str:
    """The last half, rounded down, replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def both_fingerprints(text: str, edited: str, common: int) -> tuple[np.ndarray, np.ndarray]:
    """Of two texts with the same first ``common`` code points, parsed once."""
    nodes: dict[tuple[int, str], int] = {}
    ends: list[int] = []
    at = parse(text[:common], 0, nodes, ends)
    if text == edited:
        parse(text, at, nodes, ends)
        found = signature(text, ends)
        return found, found
    own_ends = ends.copy()
    parse(text, at, nodes.copy(), own_ends)
    parse(edited, at, nodes, ends)
    return signature(text, own_ends), signature(edited, ends)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    smallest = np.union1d(a, b)[:SIZE]
    return float(np.isin(smallest, np.intersect1d(a, b)).sum() / len(smallest))


def as_text(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


LOWEST = -(1 << 63)
#: Ranges of documents for each partition, and bytes of text that a range holds at most on average.
RANGES, RANGE_BYTES = 16, 128 << 20


class Cuts:
    """Where ranges of (key, tie) begin; a key that is cut several times has its ties, which are hashes, cut evenly."""

    def __init__(self, quantiles: list[float]):
        keys, times = np.unique(np.array(quantiles, dtype=np.float64), return_counts=True)
        keys = np.clip(keys, LOWEST, -LOWEST - 1024).astype(np.int64)
        first = lambda n: [LOWEST + (k << 64) // n for k in range(n)]
        cuts = sorted({(k, t) for k, n in zip(keys.tolist(), times.tolist(), strict=True) for t in first(n)})
        self.key = np.array([k for k, _ in cuts], dtype=np.int64)
        self.tie = np.array([t for _, t in cuts], dtype=np.int64)

    def ranges(self, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
        low, high = (np.searchsorted(self.key, keys, side=s) for s in ("left", "right"))
        for at in np.unique(low[high > low]).tolist():
            rows = np.flatnonzero((low == at) & (high > low))
            low[rows] = at + np.searchsorted(self.tie[at : high[rows[0]]], ties[rows], side="right")
        return low


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Ranges of documents by ascending id, each closed by the first of the next range.

    Columns: range, guest (true for a row that belongs to another range), key (the id, null
    lowest), tie, doc_id, text.  Rows of one range lie in one partition in the order range,
    guest, key, tie.  Ranges are cut at quantiles of the ids, more of them the more text
    there is, and inside an id that many rows share at even steps of their texts' hashes;
    only the cuts and the ranges' smallest rows, two numbers per range, meet at the driver.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias("key")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    steps = max(RANGES * parts, size // RANGE_BYTES)
    places = [i / steps for i in range(1, steps)]
    cuts = Cuts(docs.select(key).approxQuantile("key", places, 1 / (4 * steps)))
    rows = docs.select(key, F.xxhash64("text").alias("tie"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ties = (column(batch, c).to_numpy() for c in ("key", "tie"))
            if len(keys):
                place = cuts.ranges(keys, ties)
                order = np.lexsort((ties, keys, place))
                nr, first = np.unique(place[order], return_index=True)
                values = [pa.array(nr), pa.array(keys[order][first]), pa.array(ties[order][first])]
                yield pa.RecordBatch.from_arrays(values, names=["range", "key", "tie"])

    least = rows.select("key", "tie").mapInArrow(smallest, "range bigint, key bigint, tie bigint")
    found = least.groupBy("range").agg(F.min(F.struct("key", "tie")).alias("row")).select("range", "row.*").collect()
    firsts = sorted(tuple(r) for r in found)
    before = {(key, tie): firsts[i - 1][0] for i, (_, key, tie) in enumerate(firsts)}
    first_keys = np.unique(np.array([key for key, _ in before], dtype=np.int64))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            keys, ties = (column(batch, c).to_numpy() for c in ("key", "tie"))
            may = np.flatnonzero(np.isin(keys, first_keys))
            guests = [k for k in may.tolist() if (int(keys[k]), int(ties[k])) in before]
            sets = [(np.arange(len(keys)), cuts.ranges(keys, ties), False)]
            if guests:
                sets.append((np.array(guests), np.array([before[int(keys[k]), int(ties[k])] for k in guests]), True))
            for rows, nr, guest in sets:
                part = batch.take(pa.array(rows)) if guest else batch
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nr.astype(np.int64)), pa.array([guest] * len(rows)), *part.columns],
                    names=["range", "guest", *part.schema.names],
                )

    placed = rows.mapInArrow(assign, "range bigint, guest boolean, key bigint, tie bigint, doc_id bigint, text string")
    return placed.repartition(max(parts, steps // RANGES), "range").sortWithinPartitions("range", "guest", "key", "tie")


FOUND = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness; see ``FOUND``.

    The edited form takes its second half from the next document by ascending id; the
    first follows the last.  Null ids come first, equal ids are ordered by a hash of their
    text.  A null text counts as empty; an empty text has the empty fingerprint, alike to
    itself and unlike all others.  A table of one document is its own next; an empty one
    gives no rows, and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row = None  # (doc_id, text) whose next document is not known yet
        waiting = None  # a finished row whose next document has no fingerprint yet
        done: int | None = None  # range that is complete
        out: list[tuple] = []

        def finish(text: str) -> tuple[tuple, np.ndarray]:
            """Closes the open row, now that ``text`` follows; returns its columns and its fingerprint."""
            doc_id, own = open_row
            edited = edited_text(own, text)
            found, other = both_fingerprints(own, edited, len(own) - len(own) // 2)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            if waiting is not None:
                out.append((*waiting[0], likeness(waiting[1], found)))
            return (doc_id, len(own), digest, as_text(found), as_text(other), likeness(found, other)), found

        for batch in small_batches(batches):
            columns = (column(batch, n).to_pylist() for n in ("range", "guest", "doc_id"))
            for nr, guest, doc_id, text in zip(*columns, texts(batch), strict=True):
                if guest and nr == done:
                    continue
                if open_row is not None:
                    waiting = finish(text)
                open_row = (doc_id, text)
                if guest:
                    out.append((*waiting[0], likeness(waiting[1], fingerprint(text))))
                    open_row, waiting, done = None, None, nr
            if out:
                yield as_batch(out)
                out.clear()

    return with_neighbours(docs).mapInArrow(run, FOUND)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
