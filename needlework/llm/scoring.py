"""Language-model scores with stupid backoff, by joining a document's n-grams with n-gram tables.

The units are the ids of a public tokenizer; texts are coded once and their ids kept in
the shared folder.  The n-grams of a batch of documents are counted where its ids are
read and sent to buckets of a hash of their context, so
the table of counts is partitioned by that hash: a bucket sums what all batches send and
answers each batch with the counts of its own n-grams and contexts.  A batch's row of
ids meets the answers, and its documents are scored and summed.
An n-gram takes one entry per batch, however common it is, and travels in a few bytes.

    S(w | u v) = c(u v w) / c(u v)                if c(u v w) > 0
                 factor * c(v w) / c(v)           else, if c(v w) > 0
                 factor**2 * c(w) / N             otherwise

A document that is part of the corpus is scored by the rest of it: its own n-grams are
taken out of every count.  So all counts are used, and only what other documents hold,
or a copy of the document, counts as seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needlework.llm.arrow import column, raw_texts, small_batches
from needlework.llm.tokens import text_ids
from needlework.tables import kept

#: Ids are below these; they stand before a document's first id and behind its last.
END, START = (1 << 16) - 2, (1 << 16) - 1
#: Counts are passed on up to this.
MOST = (1 << 32) - 1
#: Documents of a batch.
MOST_ROWS = 1 << 14
SCATTER = np.uint64(0x9E3779B1)


@dataclass(frozen=True)
class Backoff:
    """order: ids of an n-gram, 2 or 3; factor: price of a step to a shorter one; bucket: n-grams summed at a time."""

    order: int = 3
    factor: float = 0.4
    bucket: int = 1 << 21


# ---- n-grams of a batch ----------------------------------------------------------------------


def scattered(context: np.ndarray) -> np.ndarray:
    """Contexts of up to 32 bits in another order, that hashes them into ranges; one to one."""
    out = context * SCATTER & np.uint64(0xFFFFFFFF)
    out ^= out >> np.uint64(15)
    return out * SCATTER & np.uint64(0xFFFFFFFF)


def grams_of(ids: np.ndarray, sizes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams, scattered context * 2**16 + id, text by text, and their text's number.

    Every text with ids has one more at its end, so that an (order - 1)-gram occurs as often
    as all n-grams that it begins.
    """
    some = np.flatnonzero(sizes > 0)
    if not len(some):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = sizes[some] + 1
    text = np.repeat(some, size)
    ends = np.cumsum(size) - 1
    last = np.full(len(text), END, dtype=np.uint64)
    inner = np.ones(len(text), dtype=bool)
    inner[ends] = False
    last[inner] = ids
    context = np.zeros(len(text), dtype=np.uint64)
    before = last
    for k in range(order - 1):
        before = np.concatenate([[np.uint64(START)], before[:-1]])
        before[ends[:-1] + 1] = START
        context |= before << np.uint64(16 * k)
    return scattered(context) << np.uint64(16) | last, text


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers below 2**32 in few bytes: like bytes together, then compressed."""
    import zstandard

    body = [np.array([len(a) for a in arrays], dtype="<u4").tobytes()]
    body += [np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    return bytes([len(arrays)]) + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpacked(data: bytes) -> list[np.ndarray]:
    import zstandard

    body, n = zstandard.ZstdDecompressor().decompress(data[1:]), data[0]
    out, at = [], 4 * n
    for size in np.frombuffer(body, dtype="<u4", count=n).tolist():
        planes = np.frombuffer(body, dtype=np.uint8, count=4 * size, offset=at).reshape(4, size)
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
        at += 4 * size
    return out


def groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of equal sorted values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return start, np.diff(np.append(start, len(values)))


def as_bucket(grams: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted n-grams with their counts: contexts by their differences, then their ids."""
    contexts = grams >> np.uint64(16)
    start, length = groups(contexts)
    return packed(np.diff(contexts[start], prepend=np.uint64(0)), length, grams & np.uint64(0xFFFF), counts)


def from_bucket(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, length, last, counts = unpacked(data)
    contexts = np.cumsum(step, dtype=np.uint64)
    return np.repeat(contexts, length) << np.uint64(16) | last, counts.astype(np.int64)


ROW = "bucket int, batch bigint, asks boolean, data binary, doc_id array<bigint>"


def as_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64())]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "batch", "asks", "data", "doc_id"])


CODED = "batch bigint, data binary, doc_id array<bigint>"


def coded(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Per batch of documents its ids, coded once and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, nr = text_ids(tokenizer_file), TaskContext.get().partitionId() << 32
        for large in small_batches(batches, most=4 << 20):
            for batch in (large.slice(at, MOST_ROWS) for at in range(0, large.num_rows, MOST_ROWS)):
                parts = words.of(raw_texts(batch))
                sizes = np.array([len(p) for p in parts], dtype=np.int64)
                row = [[nr], [packed(np.concatenate(parts), sizes)], [column(batch, "doc_id").to_pylist()]]
                kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(*c) for c in zip(row, kinds, strict=True)], names=["batch", "data", "doc_id"])
                nr += 1

    return kept(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, CODED), "lm_ids")


def ids_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a batch's texts, one after another, and how many each has."""
    ids, sizes = unpacked(data)
    return ids, sizes.astype(np.int64)


def sent(ids: DataFrame, order: int, bits: int, asks: bool) -> DataFrame:
    """Per batch: its n-grams by bucket, the first ``bits`` bits of the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nr, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, counts = np.unique(grams_of(*ids_of(data), order)[0], return_counts=True)
                bucket = (grams >> np.uint64(48 - bits)).astype(np.int64)
                rows = []
                for start, n in zip(*groups(bucket), strict=True):
                    part = slice(start, start + n)
                    rows.append((int(bucket[start]), nr, asks, as_bucket(grams[part], counts[part]), None))
                if rows:
                    yield as_rows(rows)

    return ids.select("batch", "data").mapInArrow(run, ROW)


# ---- the tables and their answers ---------------------------------------------------------------


def answers(bucket: int, held: list[tuple], own: bool) -> Iterator[tuple]:
    """For every row (batch, asks, data) of a bucket that asks, the counts of its n-grams and contexts."""
    lists = [from_bucket(data) for _, _, data in held]
    every, place = np.unique(np.concatenate([g for g, _ in lists]), return_inverse=True)
    weight = np.concatenate([n if own or not asks else 0 * n for (_, n), (_, asks, _) in zip(lists, held, strict=True)])
    total = np.bincount(place, weights=weight, minlength=len(every)).astype(np.int64)
    start, length = groups(every >> np.uint64(16))
    context = np.repeat(np.add.reduceat(total, start), length)
    total, context = np.minimum(total, MOST), np.minimum(context, MOST)
    at = 0
    for (batch, asks, _), (grams, _) in zip(held, lists, strict=True):
        mine = place[at : at + len(grams)]
        at += len(grams)
        if asks:
            first, _ = groups(grams >> np.uint64(16))
            yield bucket, batch, True, packed(total[mine], context[mine][first]), None


def answered(rows: DataFrame, own: bool) -> DataFrame:
    """For each batch and bucket the corpus counts of its n-grams and contexts.

    Rows that do not ask make up the corpus, or all rows if the documents are their ``own``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for rows in batches:
            for bucket, batch, asks, data, _ in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if held and bucket != now:
                    yield from (as_rows([r]) for r in answers(now, held, own))
                    held = []
                now = bucket
                held.append((batch, asks, data))
        if held:
            yield from (as_rows([r]) for r in answers(now, held, own))

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, ROW)


def single_counts(ids: DataFrame) -> np.ndarray:
    """How often each id occurs; at ``START``, the number of texts with ids.  A table of 2**16 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for own, sizes in map(ids_of, batch.column(0).to_pylist()):
                total += np.bincount(own, minlength=1 << 16)
                total[START] += np.count_nonzero(sizes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    out = np.zeros(1 << 16, dtype=np.int64)
    for row in ids.select("data").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


# ---- scores -----------------------------------------------------------------------------------------


def own_counts(values: np.ndarray, *dropped: int) -> list[np.ndarray]:
    """For every value how often it occurs, without as many of its last bits, by one sort for all."""
    order = np.argsort(values)
    ordered, found = values[order], []
    for bits in dropped:
        _, length = groups(ordered >> values.dtype.type(bits))
        out = np.empty(len(values), dtype=np.int64)
        out[order] = np.repeat(length, length)
        found.append(out)
    return found


def scores(ids, sizes, gram_n, context_n, singles, how: Backoff, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sum of its ids' log scores, and how many of them backed off.

    ``gram_n`` and ``context_n`` belong to the batch's distinct n-grams and contexts, in order.
    """
    grams, text = grams_of(ids, sizes, how.order)
    every, place = np.unique(grams, return_inverse=True)
    first, length = groups(every >> np.uint64(16))
    gram_n, context_n = gram_n[place], np.repeat(context_n, length)[place]
    scored = (grams & np.uint64(0xFFFF)) != END
    number = text.astype(np.uint64) << np.uint64(48)
    if own:
        own_grams, own_contexts = own_counts(number | grams, 0, 16)
        gram_n, context_n = gram_n - own_grams, context_n - own_contexts
    last = np.where(scored, grams & np.uint64(0xFFFF), 0).astype(np.int64)
    single, before = singles[last], np.concatenate([[START], last[:-1]])
    before[np.flatnonzero(np.diff(text, prepend=-1))] = START
    before_n = singles[before]
    total = np.full(len(last), singles[:START].sum())
    if own:
        (own_single,) = own_counts(text << 16 | np.where(scored, last, END), 0)
        single = single - np.where(scored, own_single, 0)
        shifted = np.concatenate([[1], own_single[:-1]])
        before_n = before_n - np.where(before == START, 1, shifted)
        total = total - sizes[text]
    value = np.log(how.factor ** (how.order - 1) * np.maximum(single, 1) / np.maximum(total, 1))
    if how.order == 3:
        # the pair (v, w) is the context of the place that follows
        pair_n = np.append(context_n[1:], 0)
        value = np.where(pair_n > 0, np.log(how.factor * np.maximum(pair_n, 1) / np.maximum(before_n, 1)), value)
    seen = gram_n > 0
    value = np.where(seen, np.log(np.maximum(gram_n, 1) / np.maximum(context_n, 1)), value)
    sums = np.bincount(text[scored], weights=value[scored], minlength=len(sizes)).astype(np.float64)
    return sums, np.bincount(text[scored & ~seen], minlength=len(sizes))


SCORES = "doc_id bigint, n_tokens bigint, n_backoff bigint, log_score double, mean_score double"


def score(docs: DataFrame, tokenizer_file: str, corpus: DataFrame | None = None, how: Backoff = Backoff()) -> DataFrame:
    """Per document: doc_id, n_tokens, n_backoff (ids scored by backoff), log_score (their sum), mean_score.

    Without a ``corpus`` the documents are their own, and each is scored by all others.  A
    count that is needed and zero counts as one.  A null or empty text has no ids,
    log_score 0 and a null mean_score; null ids stay null, repeated rows are documents of
    their own, an empty table gives no rows, an empty corpus is as good as none of the
    n-grams seen, other columns are ignored.
    """
    own, source = corpus is None, docs if corpus is None else corpus
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(32, max(size // 3 // how.bucket, 2 * parts).bit_length())
    ids = coded(docs, tokenizer_file)
    rows, source_ids = sent(ids, how.order, bits, True), ids
    if not own:
        source_ids = coded(source, tokenizer_file)
        rows = rows.unionByName(sent(source_ids, how.order, bits, False))
    singles = single_counts(source_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch's ids come first, then the answers to its n-grams in order."""
        now, counts = None, []

        def finish() -> pa.RecordBatch:
            ids, sizes = ids_of(now[0])
            found = [unpacked(c) for c in counts]
            both = [np.concatenate([np.zeros(0, np.int64), *(f[k].astype(np.int64) for f in found)]) for k in (0, 1)]
            sums, backed = scores(ids, sizes, *both, singles, how, own)
            mean = pa.array(sums / np.maximum(sizes, 1), mask=sizes == 0)
            columns = [pa.array(now[1], pa.int64()), pa.array(sizes), pa.array(backed), pa.array(sums), mean]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCORES.split(", ")])

        for batch in batches:
            for bucket, data, doc_id in zip(*(column(batch, c).to_pylist() for c in ("bucket", "data", "doc_id")), strict=True):
                if bucket >= 0:
                    counts.append(data)
                    continue
                if now:
                    yield finish()
                now, counts = (data, doc_id), []
        if now:
            yield finish()

    asking = ids.select(F.lit(-1).alias("bucket"), "batch", F.lit(True).alias("asks"), "data", "doc_id")
    ordered = asking.unionByName(answered(rows, own)).repartition("batch").sortWithinPartitions("batch", "bucket")
    return ordered.mapInArrow(run, SCORES)
