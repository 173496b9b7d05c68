"""Order-preserving packing of token streams into windows by dynamic programming.

Texts are tokenized where they are read and packed in the order of their partition, so
no text is shuffled.  A stream of tokens may be cut at a document's end (free), at the
end of a sentence (cheap) or, every few tokens, inside a sentence (dear).  Over the
possible cuts ``p[0..m]`` with penalties ``q`` the cheapest packing is

    best[j] = min over i, p[j] - p[i] <= window, of best[i] + window - (p[j] - p[i]) + q[j]

The part that depends on ``i`` is ``best[i] + p[i]``, so a monotone queue holds the
minimum of the sliding range and every cut costs constant time.  Only the rest of a
partition, less than a window, goes into windows whose length is a power of two, which
need no padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from needlework.llm.arrow import column, raw_texts, small_batches
from needlework.llm.tokens import text_ids

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


@dataclass(frozen=True)
class Packing:
    """window: tokens of a full sequence; end_id: id that ends every document.

    sentence_cut, inner_cut: penalties in tokens of padding for cutting a document at
    the end of a sentence or elsewhere; inner_step: tokens between two possible cuts
    inside a sentence; segment: tokens that are packed together.
    """

    window: int = 4096
    end_id: int = 2
    sentence_cut: int = 2
    inner_cut: int = 12
    inner_step: int = 48
    segment: int = 1 << 19


def possible_cuts(ids: np.ndarray, ends: np.ndarray, last: np.ndarray, how: Packing) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions with their penalties; ``last`` holds the documents' ends."""
    penalty = np.full(len(ids) + 1, -1, dtype=np.int64)
    sentence = np.flatnonzero(ends[ids]) + 1
    penalty[sentence] = how.sentence_cut
    penalty[last] = 0
    fixed = np.flatnonzero(penalty >= 0)
    fixed = np.unique(np.concatenate([[0], fixed, [len(ids)]]))
    gaps = np.diff(fixed)
    wide = gaps > how.inner_step
    if wide.any():
        more = (gaps[wide] - 1) // how.inner_step
        first = np.repeat(fixed[:-1][wide], more)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(more) - more, more) + 1
        inner = first + nth * how.inner_step
        penalty[inner] = how.inner_cut
    penalty[0] = penalty[len(ids)] = 0
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Positions of the cheapest packing from the first cut on.

    It ends at whichever cut, less than a window before the last, makes it cheapest, so no
    window has to be short for the end's sake; what is left behind that cut is not packed.
    Neighbouring cuts must be no further apart than a window.
    """
    where, extra = at.tolist(), penalty.tolist()
    cost, before = [0] * len(where), [0] * len(where)
    queue, keys = deque([0]), [where[0]] * len(where)
    for j in range(1, len(where)):
        here = where[j]
        while here - where[queue[0]] > window:
            queue.popleft()
        left = queue[0]
        # of equal costs the earliest start wins: it leaves the fewest windows
        cost[j] = keys[left] + window - here + extra[j]
        before[j] = left
        keys[j] = key = cost[j] + here
        while queue and keys[queue[-1]] > key:
            queue.pop()
        queue.append(j)
    # a rest of k tokens is no padding, so ends are compared as if it were filled up
    ends = range(int(np.searchsorted(at, where[-1] - window, side="right")), len(where))
    j = min(ends, key=lambda k: (cost[k], -k))
    path = [where[j]]
    while j:
        j = before[j]
        path.append(where[j])
    return path[::-1]


def powers_of_two(length: int) -> list[int]:
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


class Packer:
    """Packs the documents of one partition, a segment at a time."""

    def __init__(self, how: Packing, ends: np.ndarray, first_id: int):
        self.how, self.ends, self.sequence = how, ends, first_id
        self.docs: list[list] = []  # doc_id, ids, how many of them are packed already
        self.waiting = 0

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        self.docs.append([doc_id, ids, 0])
        self.waiting += len(ids)
        return self.flush(False) if self.waiting >= self.how.segment else []

    def flush(self, final: bool) -> list[tuple]:
        """Pieces of all that waits; less than a window waits on, unless this is the end."""
        if not self.waiting:
            return []
        ids = np.concatenate([d[1][d[2] :] for d in self.docs])
        last = np.cumsum([len(d[1]) - d[2] for d in self.docs])
        path = best_cuts(*possible_cuts(ids, self.ends, last, self.how), self.how.window)
        lengths = np.diff(path).tolist()
        rest = len(ids) - path[-1]
        if final and rest:
            parts = powers_of_two(rest)
            lengths += parts if self.how.window - rest > self.how.inner_cut * (len(parts) - 1) else [rest]
        return self.pieces(lengths)

    def pieces(self, lengths: list[int]) -> list[tuple]:
        out, at = [], 0
        for length in lengths:
            offset = 0
            while offset < length:
                doc_id, ids, start = self.docs[at]
                n = min(length - offset, len(ids) - start)
                crc = zlib.crc32(ids[start : start + n].astype("<u4").tobytes())
                out.append((doc_id, start, n, crc, len(ids), self.sequence, offset))
                offset += n
                self.docs[at][2] = start + n
                at += start + n == len(ids)
            self.sequence += 1
            self.waiting -= length
        self.docs = self.docs[at:]
        return out


def pack(docs: DataFrame, tokenizer_file: str, how: Packing = Packing()) -> DataFrame:
    """One row per piece of a document; see ``PIECES``.

    ``tokenizer_file`` must exist wherever tasks run; see ``tokens`` for what it must do.  A null text has no ids of its own but still the end id, a null doc_id stays
    null, repeated rows are packed once each, other columns are ignored, and an empty
    table has no pieces.  Equal partitions give equal rows, so a task that runs again
    repeats its result; sequence ids start at the partition's number times 2**40.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = text_ids(tokenizer_file)
        packer = Packer(how, words.sentence_ends, TaskContext.get().partitionId() << 40)
        end = np.array([how.end_id], dtype=np.uint32)
        for batch in small_batches(batches, most=4 << 20):
            rows: list[tuple] = []
            for doc_id, ids in zip(column(batch, "doc_id").to_pylist(), words.of(raw_texts(batch)), strict=True):
                rows += packer.add(doc_id, np.concatenate([ids, end]))
            if rows:
                yield as_batch(rows)
        if rows := packer.flush(True):
            yield as_batch(rows)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [p.split()[0] for p in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
