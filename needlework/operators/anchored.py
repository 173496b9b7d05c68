"""The scan for large dictionaries, as an equi-join on short byte strings.

A pattern of up to seven bytes is its own anchor, a longer one has its first seven as
anchor and is met by a hash of its head: all its bytes, or ``ANCHOR + TAIL`` of a longer
one.  Every text gives out the distinct byte strings of the lengths that the dictionary
has, with the number of their starts, found by sorting its places once.  Before they
leave the scan they are asked from a Bloom filter of all anchors and heads, so what is
joined are the candidates and a stated few strangers, however large the text, and a
candidate meets its own pattern only, however many begin alike.  Matches of the short
patterns are exact then; a head is compared byte by byte, and what is longer with the
text itself.

UTF-8 keeps characters apart, so matches of bytes are matches of characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from needlework.functions.hits import occurrences

#: Bytes of an anchor; the tag of a longer pattern's is one more, that of its head two more.
ANCHOR = 7
HEAD = ANCHOR + 2
#: Bytes behind an anchor that leave the scan with it.
TAIL = 64
#: Of the hash of a head.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 256 * 1024 * 1024
ROW_BYTES = 128  # of a filed pattern, besides the pattern
#: Bits of the filter for an anchor: about 1.4 % of other strings pass. Beyond FILTER_BITS in all more do.
BITS, FILTER_BITS, BLOCK_BITS = 16, 1 << 28, 1 << 19
#: Texts sorted together, and their bytes; a longer text is cut into pieces of as many.
GROUP, GROUP_BYTES = 255, 1 << 20
#: Grams with more than one in so many candidates are salted.
HEAVY = 1024
#: One in so many texts is looked at to find heavy grams.
SAMPLE = 64


# ---- anchors --------------------------------------------------------------------------


def anchor(pattern: Column) -> Column:
    """Tag and bytes of a pattern's anchor as one number."""
    size = F.octet_length(pattern)
    start = F.substring(pattern.cast("binary"), 1, ANCHOR)
    value = F.conv(F.hex(start), 16, 10).cast("bigint")
    return F.when(size > 0, F.shiftleft(F.least(size, F.lit(ANCHOR + 1)).cast("bigint"), 8 * ANCHOR) + value)


def filed(dictionary: DataFrame, tail: int = TAIL) -> DataFrame:
    """pid, pattern, weight, gram (its anchor), rest (bytes behind it), whole (whether these are all), overlap."""
    size = F.octet_length("pattern")
    rest = F.when(size > ANCHOR, F.substring(F.col("pattern").cast("binary"), ANCHOR + 1, tail))
    entries = dictionary.where(F.col("pattern") != "").select("pid", "pattern", "weight")
    filed_under = entries.withColumn("gram", anchor(F.col("pattern"))).withColumn("rest", rest)
    return filed_under.withColumn("whole", size <= ANCHOR + tail).withColumn("overlap", _overlap("pattern", tail))


def filed_by_heads(dictionary: DataFrame, tail: int = TAIL) -> DataFrame:
    """As ``filed``, but gram and rest of a longer pattern are the code and the bytes of its head; its anchor is in ``first``."""
    size = F.octet_length("pattern")
    head = F.when(size > ANCHOR, F.substring(F.col("pattern").cast("binary"), 1, ANCHOR + tail))
    entries = filed(dictionary, tail).withColumn("rest", head).withColumn("first", F.col("gram"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("gram")
            gram = batch.column(at).to_numpy().view(np.uint64).copy()
            heads = [h or b"" for h in batch.column(batch.schema.names.index("rest")).to_pylist()]
            lengths = np.array([len(h) for h in heads], dtype=np.int64)
            data = np.frombuffer(b"".join([*heads, bytes(ANCHOR)]), dtype=np.uint8)
            for which, n, code in heads_at(data, np.cumsum(lengths) - lengths, lengths, sorted(set(lengths[lengths > ANCHOR].tolist()))):
                own = lengths[which] == n
                gram[which[own]] = code[own]
            yield batch.set_column(at, batch.schema.field(at), pa.array(gram.view(np.int64)))

    return entries.mapInArrow(run, entries.schema)


def _overlap(pattern: str, tail: int) -> Column:
    """Look-ahead regex if a pattern longer than its tail can overlap itself, else null."""
    p = F.col(pattern)
    bordered = F.exists(
        F.sequence(F.lit(1), F.greatest(F.char_length(p) - 1, F.lit(1))),
        lambda n: (n < F.char_length(p)) & (F.substring(p, F.lit(1), n) == F.right(p, n)),
    )
    quoted = F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.when((F.octet_length(p) > ANCHOR + tail) & bordered, F.concat(F.lit("(?=\\Q"), quoted, F.lit("\\E)")))


class Filter:
    """A Bloom filter of anchors, of a power of two of bits."""

    FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.shift = np.uint64(64 - (bits.bit_length() - 1))
        self.data = np.zeros(bits // 8, dtype=np.uint8) if data is None else data

    def places(self, grams: np.ndarray) -> list[np.ndarray]:
        return [(grams * f) >> self.shift for f in self.FACTORS]

    def passes(self, grams: np.ndarray) -> np.ndarray:
        found = np.ones(len(grams), dtype=bool)
        for at in self.places(grams):
            found &= (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def filter_of(grams: DataFrame, count: int) -> Filter:
    """The filter of a column ``gram``, joined block by block; its size follows the counted dictionary."""
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(10, (count * BITS - 1).bit_length()))
    width = min(bits, BLOCK_BITS) // 8

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(bits)
        for batch in batches:
            for at in own.places(batch.column(0).to_numpy().view(np.uint64)):
                np.bitwise_or.at(own.data, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        blocks = own.data.reshape(-1, width)
        some = np.flatnonzero(blocks.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([blocks[k].tobytes() for k in some], pa.binary())], names=["block", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[block] = found.get(block, np.uint8(0)) | np.frombuffer(data, dtype=np.uint8)
        if found:
            values = [pa.array(list(found)), pa.array([v.tobytes() for v in found.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(values, names=["block", "data"])

    schema = "block bigint, data binary"
    out = Filter(bits)
    for row in grams.mapInArrow(mark, schema).repartition("block").mapInArrow(merge, schema).collect():
        out.data[row["block"] * width :][:width] = np.frombuffer(row["data"], dtype=np.uint8)
    return out


# ---- the scan -------------------------------------------------------------------------


def codes(data: np.ndarray) -> np.ndarray:
    """The seven bytes from every place on, as numbers; ``data`` ends with as many zeros."""
    n = len(data) - ANCHOR
    out = np.zeros(n, dtype=np.uint64)
    for k in range(ANCHOR):
        out = (out << np.uint64(8)) | data[k : k + n]
    return out


def heads_at(data: np.ndarray, place: np.ndarray, left: np.ndarray, lengths: list[int]) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """For each of the ascending ``lengths`` beyond an anchor: the places with as many bytes ``left``, the length, and their codes."""
    which = np.flatnonzero(left > ANCHOR)
    code = np.zeros(len(which), dtype=np.uint64)
    for k in range(ANCHOR):
        code = (code << np.uint64(8)) | data[place[which] + k]
    for n in range(ANCHOR + 1, max(lengths, default=0) + 1):
        fits = left[which] >= n
        which, code = which[fits], code[fits]
        code = (code ^ code >> np.uint64(29)) * BASE + data[place[which] + n - 1]
        if n in lengths:
            yield which, n, (code ^ code >> np.uint64(32)) * MIX >> np.uint64(8) | np.uint64(HEAD << 8 * ANCHOR)


def heads_of(data: np.ndarray, text: np.ndarray, place: np.ndarray, left: np.ndarray, lengths: list[int], anchors: Filter) -> tuple[np.ndarray, ...]:
    """Text, code, number of starts, places and lengths of the heads at ``place`` that pass the filter."""
    nothing = np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, ...]] = [(nothing, nothing.astype(np.uint64), nothing)]
    for which, n, code in heads_at(data, place, left, lengths):
        kept = anchors.passes(code)
        found.append((which[kept], code[kept], np.full(kept.sum(), n)))
    which, code, size = (np.concatenate([f[k] for f in found]) for k in range(3))
    order = np.lexsort((code, text[which]))
    which, code, size = which[order], code[order], size[order]
    of = text[which].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (of[1:] != of[:-1])])) if len(of) else nothing
    return of[first], code[first], np.diff(np.append(first, len(of))), place[which], size


def starts_of(
    texts: list[bytes], sizes: list[int], anchors: Filter, upto: int | None = None, lengths: list[int] | None = None
) -> tuple[np.ndarray, ...]:
    """Of up to ``GROUP`` texts: text, gram, number of starts, and the places of each gram of a longer pattern, one after another.

    Places count through the joined texts, between which are ``ANCHOR`` zeros; starts from
    place ``upto`` on are left out.  With ``lengths`` of heads, these take the place of the
    longer patterns' anchors, and their own lengths come last.
    """
    data = np.frombuffer(bytes(ANCHOR).join([*texts, b""]), dtype=np.uint8)
    sized = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(sized + ANCHOR) - sized - ANCHOR
    place = np.repeat(begin - np.cumsum(sized) + sized, sized) + np.arange(sized.sum())
    text = np.repeat(np.arange(len(texts), dtype=np.uint64), sized)
    left = np.repeat(begin + sized, sized) - place
    if upto is not None:
        place, text, left = place[:upto], text[:upto], left[:upto]
    key = codes(data)[place] | text << np.uint64(8 * ANCHOR)
    if lengths and sizes[0] > ANCHOR:  # heads only, which need no order
        gram = key & np.uint64((1 << 8 * ANCHOR) - 1) | np.uint64((ANCHOR + 1) << 8 * ANCHOR)
        some = np.flatnonzero((left > ANCHOR) & anchors.passes(gram))
        return heads_of(data, text[some], place[some], left[some], lengths, anchors)
    order = np.argsort(key)
    key, left, place = key[order], left[order], place[order]
    nothing = np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, ...]] = [(nothing, nothing.astype(np.uint64), nothing, nothing, nothing)]
    for size in sizes:
        valid = left >= size
        own = key[valid] >> np.uint64(8 * (ANCHOR - min(size, ANCHOR)))
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(own)))
        bits = np.uint64(8 * min(size, ANCHOR))
        of, gram = own[first] >> bits, own[first] & ((np.uint64(1) << bits) - np.uint64(1)) | np.uint64(size << 8 * ANCHOR)
        kept = anchors.passes(gram)
        if size > ANCHOR and lengths:
            some = np.repeat(kept, n)
            at = place[valid][some]
            found.append(heads_of(data, (own >> bits)[some], at, left[valid][some], lengths, anchors))
            continue
        at = place[valid][np.repeat(kept, n)] if size > ANCHOR else nothing
        found.append((of[kept].astype(np.int64), gram[kept], n[kept], at, nothing))
    of, gram, n = (np.concatenate([f[k] for f in found]) for k in range(3))
    by_text = np.argsort(of, kind="stable")
    # grams of longer patterns come from one size only, so their places keep the order of the texts
    return of[by_text], gram[by_text], n[by_text], *(np.concatenate([f[k] for f in found]) for k in (3, 4))


def starts_in_pieces(text: bytes, sizes: list[int], anchors: Filter, piece: int, lengths: list[int] | None = None) -> tuple[np.ndarray, ...]:
    """The same of one long text, sorted piece by piece; the pieces' anchors and heads reach into the next."""
    parts, reach = [], max([ANCHOR, *(lengths or [])])
    for at in range(0, len(text), piece):
        _, gram, n, place, size = starts_of([text[at : at + piece + reach]], sizes, anchors, piece, lengths)
        tall = is_tall(gram)
        parts.append((gram, n, np.repeat(gram[tall], n[tall]), place + at, size))
    every, counts, gram_of, place, size = (np.concatenate([p[k] for p in parts]) for k in range(5))
    gram, which = np.unique(every, return_inverse=True)
    n = np.bincount(which, weights=counts, minlength=len(gram)).astype(np.int64)
    order = np.argsort(gram_of, kind="stable")
    return np.zeros(len(gram), np.int64), gram, n, place[order], size[order] if lengths else size


def is_tall(gram: np.ndarray) -> np.ndarray:
    """Whether anchors are those of longer patterns."""
    return gram >> np.uint64(8 * ANCHOR) > ANCHOR


def bytes_at(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The ``size`` bytes from each ``start`` on."""
    before = np.cumsum(size) - size
    at = np.repeat(start - before, size) + np.arange(size.sum())
    offsets = np.append(before, size.sum()).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def grouped(values: list[bytes], piece: int) -> Iterator[tuple[int, int]]:
    """Stretches of texts that are sorted together."""
    start, size = 0, 0
    for k, text in enumerate(values):
        if k > start and (k - start == GROUP or size + len(text) > piece):
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(values):
        yield start, len(values)


def candidates(
    texts: DataFrame,
    columns: list[str],
    text: str,
    sizes: list[int],
    anchors: Filter,
    tail: int = TAIL,
    piece: int = GROUP_BYTES,
    lengths: list[int] | None = None,
) -> DataFrame:
    """(columns, gram, starts, tails): the texts' byte strings that pass the filter; one row per text and string.

    For longer patterns these are anchors, with the bytes behind each start, or, with
    ``lengths``, heads, with their own bytes.
    """
    source = texts.select(*columns, F.col(text).alias("_scanned"))
    kinds = {"gram": LongType(), "starts": IntegerType(), "tails": ArrayType(BinaryType())}
    found_type = ArrayType(StructType([StructField(n, t) for n, t in kinds.items()]))
    schema = StructType([*texts.select(*columns).schema.fields, StructField("_found", found_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [v or b"" for v in batch.column(len(columns)).cast(pa.large_binary()).to_pylist()]
            for lo, hi in grouped(values, piece):
                own = values[lo:hi]
                long = len(own) == 1 and len(own[0]) > piece
                found_in = starts_in_pieces(own[0], sizes, anchors, piece, lengths) if long else starts_of(own, sizes, anchors, None, lengths)
                of, gram, n, place, head = found_in
                data = np.frombuffer(bytes(ANCHOR).join(own), dtype=np.uint8)
                stop = np.cumsum([len(t) + ANCHOR for t in own]) - ANCHOR
                tall = is_tall(gram)
                behind = place + ANCHOR
                tails = bytes_at(data, place, head) if lengths else bytes_at(data, behind, np.minimum(np.repeat(stop[of[tall]], n[tall]) - behind, tail))
                ends = np.append(0, np.cumsum(np.where(tall, n, 0))).astype(np.int32)
                bounds = np.append(0, np.cumsum(np.bincount(of, minlength=len(own)))).astype(np.int32)
                parts = [pa.array(gram.view(np.int64)), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), tails)]
                found = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(parts, names=list(kinds)))
                keys = [batch.column(k).slice(lo, hi - lo) for k in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*keys, found], names=[*columns, "_found"])

    return source.mapInArrow(run, schema).select(*columns, F.inline("_found"))


def anchored_hits(
    texts: DataFrame,
    dictionary: DataFrame,
    keys: list[str],
    text: str,
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
    tail: int = TAIL,
    piece: int = GROUP_BYTES,
) -> DataFrame:
    """(keys, pid, pattern, weight, hits), one row per text and pattern found in it.

    The dictionary is measured first.  Within the bounds it is broadcast and only
    confirmed hits leave the scan.  Beyond them the texts are scanned for the short and for
    the longer patterns by turns: short ones, of which there are few, are broadcast if they
    are within the bounds; other candidates and patterns are shuffled, with salts by the
    measured share of a gram.
    """
    entries = filed_by_heads(dictionary, tail)
    size, of = F.octet_length("pattern"), F.shiftright("first", 8 * ANCHOR).cast("int")
    measured = (
        entries.groupBy(of.alias("size"), F.octet_length("rest").alias("head"))
        .agg(F.count("*").alias("n"), F.sum(size * 3 + ROW_BYTES).alias("bytes"), F.max(size).alias("longest"))
        .collect()  # one row per length of an anchor or head
    )
    rows, longest = sum(r["n"] for r in measured), max((r["longest"] for r in measured), default=0)
    lengths = sorted(r["head"] for r in measured if r["head"])
    anchors = filter_of(entries.select(F.explode(F.array("gram", "first"))), max(rows + sum(r["n"] for r in measured if r["head"]), 1))

    def met(lot: list) -> DataFrame:
        """Candidates of a lot of sizes beside the patterns of their grams."""
        sizes = sorted({r["size"] for r in lot})
        found = candidates(texts, keys, text, sizes, anchors, tail, piece, lengths)
        own = entries.where(of.isin(sizes)).drop("first")
        if within(lot):
            return found.join(F.broadcast(own), "gram")
        sample = texts.where(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0)
        return _salted(found, own, candidates(sample, keys, text, sizes, anchors, tail, piece, lengths).select("gram"), keys)

    def within(lot: list) -> bool:
        return sum(r["n"] for r in lot) <= broadcast_rows and sum(r["bytes"] for r in lot) <= broadcast_bytes

    short, tall = [r for r in measured if not r["head"]], [r for r in measured if r["head"]]
    lots = [measured] if within(measured) or not (short and tall) else [short, tall]
    every = reduce(DataFrame.unionByName, map(met, lots))
    matching = F.filter("tails", lambda head: head == F.col("rest"))
    hits = F.when(F.col("rest").isNull(), F.col("starts")).otherwise(F.size(matching)).cast("bigint").alias("hits")
    every = every.select(*keys, "pid", "pattern", "weight", "whole", "overlap", hits).where("hits > 0")
    if longest <= ANCHOR + tail:
        return every.select(*keys, "pid", "pattern", "weight", "hits")
    done = every.where("whole").select(*keys, "pid", "pattern", "weight", "hits")
    return done.unionByName(_compared(every.where("NOT whole"), texts, keys, text))


def _salted(found: DataFrame, entries: DataFrame, sample: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates beside their patterns, by a shuffle.

    A gram that holds more than one in ``HEAVY`` of the sampled candidates is dealt out over
    as many parts as its share asks for, and its patterns are copied to each; there
    are fewer than ``HEAVY`` such grams.
    """
    counted = sample.groupBy("gram").count().cache()
    total = counted.agg(F.sum("count")).first()[0] or 0
    parts = F.ceil(F.col("count") * HEAVY / F.lit(max(total, 1))).cast("int").alias("_parts")
    heavy = counted.where(F.col("count") * HEAVY > total).select("gram", parts).collect()
    counted.unpersist()
    salts = {r["gram"]: r["_parts"] for r in heavy if r["_parts"] > 1}
    known = F.create_map(*[F.lit(v).cast("bigint") if k % 2 == 0 else F.lit(v) for k, v in enumerate(x for pair in salts.items() for x in pair)]) if salts else None
    n = F.coalesce(known[F.col("gram")], F.lit(1)) if salts else F.lit(1)
    left = found.withColumn("_salt", F.pmod(F.xxhash64(*keys), n).cast("int"))
    right = entries.withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))
    return left.join(right, ["gram", "_salt"]).drop("_salt")


def _compared(met: DataFrame, texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Hits of patterns longer than their tails, counted in the texts themselves.

    Rows equal in key and text bring the same candidates, which are taken once and meet
    each of these rows; a null or repeated key loses and multiplies nothing.
    """
    names = [f"_candidate_{i}" for i in range(len(keys))]
    once_each = met.select(*keys, "pid", "pattern", "weight", "overlap").distinct()
    once_each = once_each.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(keys, names, strict=True)]
    # Coalesced so that no null check on the text is derived and evaluated beforehand.
    holds = F.coalesce(F.contains(F.col(text), F.col("pattern")), F.lit(False))
    rows = texts.select(*keys, text).join(once_each, same).where(holds)
    count = occurrences(F.col(text), F.col("pattern"), F.col("overlap"))
    return rows.select(*keys, "pid", "pattern", "weight", count.alias("hits"))
