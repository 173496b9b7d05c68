"""Jaccard join of word n-gram sets by vertical partitioning.

Two documents link if their sets of ``width``-word n-grams are alike enough.  A document
can only have a link if that share of its own n-grams occurs elsewhere, so first all
n-grams meet in buckets of hashes, batch by batch of documents and in a few bytes each,
and come back as one number per document: how many of its n-grams others share.  Only
documents with enough of them go on, equal sets as one.

Among these the n-grams have one global order, rare ones first.  The order is cut into
fragments and every set with it, so a set is a few segments, one per fragment.  Pairs
that share one of their first n-grams (by the sizes of the sets no pair can link
otherwise, and what follows must still suffice) are counted fragment by fragment; the
sum of a pair's partial overlaps decides.  Where many sets meet under an n-gram, each is
first tried against one chosen set there, turn by turn; after that only pairs between
different components are left to be counted, so a crowd of near copies costs about its
number, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needlework.llm.arrow import column, lower_texts, small_batches
from needlework.llm.components import components, stars
from needlework.llm.hot import lookup
from needlework.llm.store import stored

FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIXERS = ((np.uint64(30), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(27), np.uint64(0x94D049BB133111EB)))
#: In place of a document's number: the n-gram is in several documents of its batch.
SEVERAL = 0xFFFF
#: Documents of a batch, below ``SEVERAL``.
MOST_ROWS = 1 << 15
#: Ids that are sent to all tasks; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


@dataclass(frozen=True)
class Join:
    """width: words of an n-gram; percent: least size of the intersection, in hundredths of the union's;
    fragments: about how many the order is cut into; bucket: n-grams that are compared at a time."""

    width: int = 5
    percent: int = 80
    fragments: int = 8
    bucket: int = 1 << 21

    def own(self, n: Column) -> Column:
        """Least overlap of a set with another."""
        return F.ceil(n * self.percent / F.lit(100))

    def overlap(self, n: Column, m: Column) -> Column:
        """Least overlap of two sets of n and m: p / (100 + p) of their sum."""
        return F.ceil((n + m) * self.percent / F.lit(100 + self.percent))


def grams_of(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of texts, as 64-bit hashes, with their text's number, both in order.

    Words are cut at ASCII white space, A-Z are lower-cased.  A text of fewer words has
    all of them as its only n-gram, one without words or a null none.
    """
    split = pc.ascii_split_whitespace(lower_texts(values))
    flat, owner = split.flatten(), pc.list_parent_indices(split).to_numpy()
    real = pc.not_equal(pc.binary_length(flat), 0)
    flat, owner = flat.filter(real), owner[real.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), dtype=np.uint64, count=len(names))
    words = hashes[coded.indices.to_numpy()]
    sizes = np.bincount(owner, minlength=len(values))
    many = np.where(sizes > 0, np.maximum(sizes - width + 1, 1), 0)
    text = np.repeat(np.arange(len(values)), many)
    first = np.arange(len(text)) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(many) - many), many)
    length = np.minimum(sizes, width)[text]
    mixed = length.astype(np.uint64)
    for k in range(width):
        inside = k < length
        if inside.all():
            mixed = mixed * FACTOR + words[first + k]
        else:
            mixed[inside] = mixed[inside] * FACTOR + words[first[inside] + k]
    for shift, factor in MIXERS:
        mixed = (mixed ^ (mixed >> shift)) * factor
    mixed ^= mixed >> np.uint64(31)
    order = np.argsort(mixed)
    order = order[np.argsort(text[order].astype(np.int32), kind="stable")]
    mixed, text = mixed[order], text[order]
    new = np.ones(len(mixed), dtype=bool)
    new[1:] = (mixed[1:] != mixed[:-1]) | (text[1:] != text[:-1])
    return mixed[new], text[new]


def shared_counts(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """doc_id, n (size of the set), shared (how many of its n-grams other documents have, or a few more), stored.

    Hashes are cut to 32 bits within a bucket here, so a rare stranger may count as shared;
    that only sends a document too many on.  An n-gram goes to its bucket once per batch,
    however many documents of the batch hold it.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(size // 6 // how.bucket, 2 * parts).bit_length()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nr = TaskContext.get().partitionId() << 32
        for large in small_batches(batches, most=6 << 20):
            for batch in (large.slice(at, MOST_ROWS) for at in range(0, large.num_rows, MOST_ROWS)):
                grams, text = grams_of(column(batch, "text"), how.width)
                n = np.bincount(text, minlength=batch.num_rows)
                order = np.argsort(grams)
                grams, text = grams[order], text[order]
                starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, int)
                times = np.diff(np.append(starts, len(grams)))
                here = np.bincount(text[np.repeat(times, times) > 1], minlength=batch.num_rows)
                at = np.where(times > 1, SEVERAL, text[starts]).astype(np.uint16)
                grams = grams[starts]
                bucket = (grams >> np.uint64(64 - bits)).astype(np.int64)
                low = (grams >> np.uint64(32 - bits)).astype(np.uint32)
                begin = np.flatnonzero(np.diff(bucket, prepend=-1))
                end = np.append(begin[1:], len(bucket))[: len(begin)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([-1, *bucket[begin].tolist()], pa.int32()),
                        pa.array(np.full(len(begin) + 1, nr)),
                        pa.array([None, *(low[b:e].tobytes() for b, e in zip(begin, end, strict=True))], pa.binary()),
                        pa.array([None, *(at[b:e].tobytes() for b, e in zip(begin, end, strict=True))], pa.binary()),
                        pa.array([column(batch, "doc_id").to_pylist(), *[None] * len(begin)], pa.list_(pa.int64())),
                        pa.array([n.tolist(), *[None] * len(begin)], pa.list_(pa.int32())),
                        pa.array([here.tolist(), *[None] * len(begin)], pa.list_(pa.int32())),
                    ],
                    names=["bucket", "batch", "low", "at", "doc_id", "n", "here"],
                )
                nr += 1

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in same_values(batches, "bucket"):
            if bucket == -1:
                yield counted(*(column(rows, c).to_pylist() for c in ("batch", "doc_id", "n", "here")), [None] * rows.num_rows)
                continue
            low = [np.frombuffer(x, dtype=np.uint32) for x in column(rows, "low").to_pylist()]
            at = [np.frombuffer(x, dtype=np.uint16) for x in column(rows, "at").to_pylist()]
            values = np.concatenate(low)
            order = np.argsort(values)
            ordered = values[order]
            equal = ordered[1:] == ordered[:-1]
            twice = np.zeros(len(values), dtype=bool)
            twice[order[1:]] = equal
            twice[order[:-1]] |= equal
            counts = []
            for a, own in zip(at, np.split(twice, np.cumsum([len(x) for x in low])[:-1]), strict=True):
                found = a[own & (a != SEVERAL)]
                counts.append(np.bincount(found).astype(np.uint32).tobytes() if len(found) else None)
            nothing = [None] * rows.num_rows
            found = counted(column(rows, "batch").to_pylist(), nothing, nothing, nothing, counts)
            yield found.filter(pa.array([c is not None for c in counts]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The row that holds a batch's documents comes last in the batch."""
        nr, total = None, np.zeros(0, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                if row["batch"] != nr:
                    nr, total = row["batch"], np.zeros(0, np.int64)
                if row["count"] is not None:
                    more = np.frombuffer(row["count"], dtype=np.uint32)
                    total = np.pad(total, (0, max(0, len(more) - len(total))))
                    total[: len(more)] += more
                    continue
                here = np.array(row["here"], dtype=np.int64)
                here[: len(total)] += total
                columns = [pa.array(row["doc_id"], pa.int64()), pa.array(row["n"], pa.int64()), pa.array(here)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "shared"])

    lists = "doc_id array<bigint>, n array<int>, here array<int>"
    sent = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        send, f"bucket int, batch bigint, low binary, at binary, {lists}"
    )
    place = F.when(F.col("bucket") < 0, F.xxhash64("batch")).otherwise(F.col("bucket"))
    met = sent.repartition(place).sortWithinPartitions("bucket").mapInArrow(meet, f"batch bigint, {lists}, count binary")
    summed = met.repartition("batch").sortWithinPartitions("batch", F.col("count").isNull())
    return stored(summed.mapInArrow(add, "doc_id bigint, n bigint, shared bigint"))


def counted(*columns: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["batch", "doc_id", "n", "here", "count"])


def same_values(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """All rows of one value together, for rows sorted by it; those of -1 as they come."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = column(batch, name).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if held and column(held[0], name)[0].as_py() != values[start]:
                yield column(held[0], name)[0].as_py(), joined(held)
                held = []
            held.append(batch.slice(start, end - start))
            if values[start] == -1:
                yield -1, held.pop()
    if held:
        yield column(held[0], name)[0].as_py(), joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches(batches)


def sets_of(docs: DataFrame, how: Join) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set) and the set's n-grams as signed numbers, stored; without empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            grams, text = grams_of(column(batch, "text"), how.width)
            n = np.bincount(text, minlength=batch.num_rows)
            ends = np.cumsum(n)
            parts = [grams[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            digests = [np.array([xxhash.xxh64_intdigest(p, s) for p in parts], dtype=np.uint64).view(np.int64) for s in (1, 2)]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(grams.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(n), *map(pa.array, digests), lists], names=["doc_id", "n", "d1", "d2", "grams"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return stored(rows.mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, grams array<bigint>"))


def in_order(sets: DataFrame, total: int) -> DataFrame:
    """sid, n and the n-grams that other sets have too, (level, gram) in the global order: by the power of two
    of their frequency, then by hash.  Stored."""
    each = stored(sets.select("sid", "n", F.explode("grams").alias("gram")))
    often = each.groupBy("gram").agg(F.count("*").alias("times")).where("times > 1")
    level = F.floor(F.log2(F.col("times"))).cast("int").alias("level")
    shared = lookup(each, often.select("gram", level, "times"), ["gram"], "times", total)
    listed = shared.groupBy("sid", "n").agg(F.sort_array(F.collect_list(F.struct("level", "gram"))).alias("grams"))
    return stored(listed)


def segments_of(ordered: DataFrame, how: Join) -> DataFrame:
    """sid, fragment, part: the n-grams of a set by the fragment of the order that they lie in.

    Every power of two of the frequency is cut into as many equal ranges of hashes as its
    share of all n-grams asks for.
    """
    levels = ordered.select(F.explode("grams").alias("g")).groupBy("g.level").count().collect()
    total, cuts, first = sum(r["count"] for r in levels), [], 0
    for level, n in sorted((r["level"], r["count"]) for r in levels):
        pieces = max(1, round(how.fragments * n / total))
        cuts.append((level, first, pieces))
        first += pieces

    def fragment(g: Column) -> Column:
        place = F.shiftright(g["gram"], 48) + 32768
        out = F.lit(0)
        for level, start, pieces in cuts:
            out = F.when(g["level"] == level, start + F.floor(place * pieces / 65536)).otherwise(out)
        return out.cast("int")

    numbered = F.transform("grams", lambda g: F.struct(fragment(g).alias("f"), g["gram"].alias("gram")))
    rows = ordered.select("sid", numbered.alias("all")).select("sid", "all", F.explode(F.array_distinct(F.col("all.f"))).alias("fragment"))
    part = F.transform(F.filter("all", lambda g: g["f"] == F.col("fragment")), lambda g: g["gram"])
    return stored(rows.select("sid", "fragment", part.alias("part")))


def postings_of(ordered: DataFrame, how: Join) -> DataFrame:
    """gram, sid, n, at (place of the n-gram in the set's order) for the first n-grams of each set, stored.

    ``short`` marks those that count if the other set is at least as large.
    """
    size = F.size("grams")
    rows = ordered.where(F.col("n") - size <= F.col("n") - how.own(F.col("n")))
    first = F.slice("grams", F.lit(1), F.greatest(F.lit(0), size - how.own(F.col("n")).cast("int") + 1))
    rows = rows.select("sid", "n", (F.col("n") - size).alias("before"), F.posexplode(first).alias("k", "g"))
    at = (F.col("before") + F.col("k")).alias("at")
    rows = rows.select(F.col("g.gram").alias("gram"), "sid", "n", "before", at)
    return stored(rows.withColumn("short", F.col("at") <= F.col("n") - how.overlap(F.col("n"), F.col("n"))))


def may_link(how: Join) -> Column:
    """Whether x and y, x first by size and number, may link, judged by an n-gram that both have."""
    need = how.overlap(F.col("x.n"), F.col("y.n"))
    rest = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    first = F.struct(F.col("x.n"), F.col("x.sid")) < F.struct(F.col("y.n"), F.col("y.sid"))
    return first & F.col("x.short") & (F.col("x.n") * 100 >= F.col("y.n") * how.percent) & (rest >= need)


PAIR = ("x.sid as a", "y.sid as b", "x.n as n", "y.n as m", "x.root as ra", "y.root as rb")


def linked(pairs: DataFrame, segments: DataFrame, how: Join) -> DataFrame:
    """The pairs (a, b) whose overlaps, counted per fragment and summed, suffice, with their components (ra, rb)."""
    left = segments.select(F.col("sid").alias("a"), "fragment", F.col("part").alias("own"))
    right = segments.select(F.col("sid").alias("b"), "fragment", F.col("part").alias("other"))
    partial = pairs.distinct().join(left, "a").join(right, ["b", "fragment"])
    pair = ["a", "b", "n", "m", "ra", "rb"]
    partial = partial.select(*pair, F.size(F.array_intersect("own", "other")).alias("common"))
    summed = partial.groupBy(*pair).agg(F.sum("common").alias("common"))
    return summed.where("100 * common >= %d * (n + m - common)" % how.percent).select("a", "b", "ra", "rb")


def tried(postings: DataFrame, total: int, turn: int) -> DataFrame:
    """Pairs x, y of sets in different components: every set, and the one chosen among all under the same n-gram.

    At first the set with the fewest n-grams of its own is chosen, as what the others were
    copied from has none; then, turn by turn, others by a hash.
    """
    rank = F.col("before") if turn == 0 else F.xxhash64("sid", F.lit(turn))
    row = F.struct("n", "sid", "at", "short", "root").alias("row")
    heads = postings.groupBy("gram").agg(F.min_by(row, F.struct(rank, "sid")).alias("head"), F.count("*").alias("rows"))
    met = lookup(postings.select("gram", row), heads, ["gram"], "rows", total)
    met = met.where(F.col("row.root") != F.col("head.root"))
    return met.select(F.least("row", "head").alias("x"), F.greatest("row", "head").alias("y"))


def merged(postings: DataFrame, links: DataFrame, total: int) -> DataFrame:
    """The postings with their components joined by new links; stored."""
    tops = stars(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    counts = postings.groupBy("root").agg(F.count("*").alias("rows"))
    places = counts.join(tops.select(F.col("a").alias("root"), F.col("b").alias("_top")), "root", "left")
    moved = lookup(postings, places, ["root"], "rows", total)
    return stored(moved.withColumn("root", F.coalesce("_top", "root")).drop("_top"))


def apart(postings: DataFrame) -> int:
    """How often two sets of different components still meet under an n-gram."""
    each = postings.groupBy("gram", "root").agg(F.count("*").cast("decimal(38,0)").alias("rows"))
    pairs = each.groupBy("gram").agg((F.pow(F.sum("rows").cast("double"), 2) - F.sum(F.pow(F.col("rows").cast("double"), 2))).alias("pairs"))
    return int((pairs.agg(F.sum("pairs")).first()[0] or 0) / 2)


#: Turns after which the pairs still apart are counted one by one, however many.
TURNS = 8


def links_of(sets: DataFrame, how: Join) -> DataFrame:
    """Links (a, b) between sets whose components are those of all pairs that link.

    Turns of trying all sets against chosen ones go on while they bring together at least
    a third of the pairs still apart; these are then all counted.
    """
    ordered = in_order(sets, sets.agg(F.sum("n")).first()[0] or 0)
    segments, postings = segments_of(ordered, how), postings_of(ordered, how).withColumn("root", F.col("sid"))
    total, found, left = postings.count(), [], apart(postings)
    for turn in range(TURNS):
        if left <= total:
            break
        found.append(stored(linked(tried(postings, total, turn).where(may_link(how)).selectExpr(*PAIR), segments, how)))
        postings, before = merged(postings, found[-1], total), left
        left = apart(postings)
        if 3 * left > 2 * before:
            break
    x, y = postings.alias("x"), postings.alias("y")
    rest = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.root") != F.col("y.root")) & may_link(how))
    found.append(stored(linked(rest.selectExpr(*PAIR), segments, how)))
    return reduce(DataFrame.unionByName, found).select("a", "b")


def jaccard_classes(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """Per document: doc_id, n_shingles (size of its set), component_id (smallest doc_id reachable by links).

    Null or empty texts and those without words have the empty set, linked with nothing.
    A null doc_id is kept; it names a component only if that has no other.  Repeated rows
    each come back, equal sets are always linked, an empty table gives no rows, other
    columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    measured = shared_counts(docs, how)
    ids = stored(measured.where(F.col("n") > 0).where(F.col("shared") >= how.own(F.col("n"))).select("doc_id").distinct())
    known = ids.withColumnRenamed("doc_id", "_known")
    if ids.count() <= BROADCAST_IDS:
        known = F.broadcast(known)
    same = F.col("doc_id").eqNullSafe(F.col("_known"))
    each = sets_of(docs.join(known, same, "left_semi"), how).withColumn("rid", F.monotonically_increasing_id())
    kinds = ["d1", "d2"]
    equal = stored(
        each.where("n > 0").groupBy(*kinds).agg(F.min("doc_id").alias("doc_id"), F.min("rid").alias("sid"), F.count("*").alias("rows"))
    )
    sets = stored(each.join(equal.select(F.col("sid").alias("rid")), "rid").select(F.col("rid").alias("sid"), "n", "grams"))
    found = components(links_of(sets, how), equal.select(F.col("sid").alias("node"), "doc_id"))
    labels = equal.join(found.select(F.col("node").alias("sid"), "label"), "sid").select(*kinds, "label", "rows")
    some = lookup(each.where("n > 0"), labels, kinds, "rows", each.count()).select("doc_id", "n", "label")
    none = each.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("label"))
    others = measured.join(known, same, "left_anti").select("doc_id", "n", F.col("doc_id").alias("label"))
    all_rows = some.unionByName(none).unionByName(others)
    return all_rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("label").alias("component_id"))
