"""Near-duplicates by 64-bit SimHash fingerprints and a byte-position index.

Two fingerprints that differ in at most ``d`` of their 8 bytes' bits agree in at least
``8 - d`` whole bytes.  The index therefore files every distinct fingerprint under each
choice of ``8 - d`` byte positions with the bytes found there, so whatever meets under a
key already shares the guaranteed minimum.  For a pair that meets, its equal bytes are
tallied; it is kept if they reach the minimum and the key names the first of them (so
each pair is looked at once), and verified by counting differing bits.

Rows of one key are sorted next to each other in a partition and compared in numpy.  A
partition passes on a spanning forest of what it linked, never the pairs.  Keys shared by
more than ``crowd`` fingerprints are not compared pairwise at all: both ends of a link of
up to 4 bits lie within 2 bits of a common middle, so these fingerprints are filed again
under all their neighbours within half the distance; all that share one are linked, as
they are within the distance of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needlework.llm.arrow import column, raw_texts, small_batches
from needlework.llm.components import components
from needlework.llm.hot import lookup
from needlework.llm.store import stored

SEED = 42
SHINGLE = 4
DISTANCE = 4
#: Fingerprints under one key from which the index turns to shared neighbours.
CROWD = 2048


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """SimHash of the word shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], SEED) for a, b in zip(starts.tolist(), last, strict=False)]
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype=">u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Replaces ``text`` by its fingerprint (signed 64 bits); a null text counts as one without words."""
    names = [c for c in docs.columns if c != "text"]
    schema = docs.select(*names).schema.add("fingerprint", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = np.array([fingerprint(t) for t in raw_texts(batch)], dtype=np.uint64).view(np.int64)
            columns = [*[column(batch, n) for n in names], pa.array(found)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "fingerprint"])

    return docs.mapInArrow(run, schema)


def choices(distance: int) -> list[tuple[int, ...]]:
    """The choices of byte positions that must agree, in order."""
    return list(combinations(range(8), 8 - distance))


def index(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (number of the choice, then its bytes) and fingerprints, choice by choice.

    From distance 2 on the number and the bytes fit in 64 bits.
    """
    data = prints.view(np.uint8).reshape(-1, 8).astype(np.uint64)
    keys = []
    for nr, positions in enumerate(choices(distance)):
        key = np.full(len(prints), nr, dtype=np.uint64)
        for p in positions:
            key = key * np.uint64(256) + data[:, p]
        keys.append(key)
    return np.concatenate(keys), np.tile(prints, len(keys))


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def first_agreement(a: np.ndarray, b: np.ndarray, positions: np.ndarray, distance: int) -> np.ndarray:
    """Whether the tally of equal bytes reaches the minimum and ``positions`` are the first of them."""
    equal = (a ^ b).view(np.uint8).reshape(-1, 8) == 0
    tally = np.cumsum(equal, axis=1)
    least = 8 - distance
    first = equal & (tally <= least)
    return (tally[:, -1] >= least) & (np.packbits(first, axis=1)[:, 0] == positions)


class Forest:
    """Smallest-first union of numbered nodes, kept as links to a root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        parent = self.parent
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(parent, high, low)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        parent = self.parent
        while True:
            up = parent[nodes]
            if (up == nodes).all():
                return nodes
            parent[nodes] = parent[up]
            nodes = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        roots = self.roots(np.arange(len(self.parent)))
        nodes = np.flatnonzero(roots != np.arange(len(roots)))
        return nodes, roots[nodes]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of equal sorted keys."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return starts, np.diff(np.append(starts, len(keys)))


def linked(keys: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the verified links under common keys; equal keys are neighbours."""
    starts, lengths = runs(keys)
    several = np.repeat(lengths, lengths) > 1
    keys, prints = keys[several], prints[several]
    unique, node = np.unique(prints, return_inverse=True)
    forest = Forest(len(unique))
    masks = np.array([int(np.packbits(np.isin(np.arange(8), c))[0]) for c in choices(distance)], dtype=np.uint8)
    active, step = np.arange(len(keys)), 1
    while len(active):
        # every row against the one ``step`` places further under the same key
        active = active[active + step < len(keys)]
        active = active[keys[active] == keys[active + step]]
        for at in range(0, len(active), 1 << 18):
            part = active[at : at + (1 << 18)]
            part = part[differing_bits(prints[part], prints[part + step]) <= distance]
            positions = masks[number_of_choice(keys[part], distance)]
            part = part[first_agreement(prints[part], prints[part + step], positions, distance)]
            forest.link(node[part], node[part + step])
        step += 1
    child, root = forest.links()
    return unique[child], unique[root]


def number_of_choice(keys: np.ndarray, distance: int) -> np.ndarray:
    return (keys >> np.uint64(8 * (8 - distance))).astype(np.int64)


def middles_of(prints: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """The fingerprints themselves, then all others within half the distance, flip by flip."""
    for r in range(distance // 2 + 1):
        for bits in combinations(range(64), r):
            yield prints ^ np.uint64(sum(1 << b for b in bits))


def unsigned(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [np.ascontiguousarray(column(batch, n).to_numpy(zero_copy_only=False)).view(np.uint64) for n in names]


def as_links(child: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(child.view(np.int64)), pa.array(root.view(np.int64))], names=["a", "b"]
    )


def compare(batches: Iterator[tuple[np.ndarray, np.ndarray]], distance: int, crowd: int, most: int = 1 << 20):
    """Links within the keys of a partition that is sorted by key, a stretch at a time.

    Yields pairs of arrays.  A fingerprint under a key with more than ``crowd`` others
    comes back paired with itself, a mark for the second index; such a key is passed
    through, never held.
    """
    nothing = np.zeros(0, np.uint64)
    keys, prints, crowded = nothing, nothing, None
    for more in batches:
        keys, prints = np.concatenate([keys, more[0]]), np.concatenate([prints, more[1]])
        if crowded is not None:
            rest = keys == crowded
            yield prints[rest], prints[rest]
            keys, prints = keys[~rest], prints[~rest]
        if len(keys) < most:
            continue
        other = np.flatnonzero(keys != keys[-1])
        whole = other[-1] + 1 if len(other) else 0
        yield from settle(keys[:whole], prints[:whole], distance, crowd)
        keys, prints = keys[whole:], prints[whole:]
        if len(keys) > crowd:
            crowded = keys[0]
            yield prints, prints
            keys, prints = nothing, nothing
    yield from settle(keys, prints, distance, crowd)


def settle(keys: np.ndarray, prints: np.ndarray, distance: int, crowd: int):
    """Links of whole keys; see ``compare``."""
    if not len(keys):
        return
    _, lengths = runs(keys)
    many = np.repeat(lengths, lengths) > crowd
    if many.any():
        yield prints[many], prints[many]
    yield linked(keys[~many], prints[~many], distance)


def links(prints: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all pairs.

    ``prints`` has one row per distinct ``fingerprint``; ``distance`` is 2 or 4.
    """

    def file_under_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                keys, found = index(*unsigned(batch.slice(at, 4096), "fingerprint"), distance)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(found.view(np.int64))], names=["key", "fingerprint"]
                )

    def compare_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for child, root in compare((unsigned(b, "key", "fingerprint") for b in batches), distance, crowd):
            if len(child):
                yield as_links(child, root)

    def file_under_middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (values,) = unsigned(batch, "a")
            for middle in middles_of(values, distance):
                yield as_links(middle, values)

    keyed = prints.select("fingerprint").mapInArrow(file_under_keys, "key bigint, fingerprint bigint")
    sorted_keys = keyed.repartition("key").sortWithinPartitions("key")
    found = stored(sorted_keys.mapInArrow(compare_keys, "a bigint, b bigint"))
    crowded = found.where("a = b").select("a").distinct()
    middles = crowded.mapInArrow(file_under_middles, "a bigint, b bigint")
    first = middles.groupBy("a").agg(F.min("b").alias("b"))
    shared = middles.join(first.withColumnRenamed("b", "first"), "a").where("b != first")
    return found.where("a != b").unionByName(shared.select(F.col("b").alias("a"), F.col("first").alias("b")).distinct())


def classes(each: DataFrame, distance: int) -> DataFrame:
    """fingerprint, root, component_id (smallest doc_id), rows (of ``each``) for the fingerprints of ``each``.

    Documents with equal fingerprints are one node, so copies are never paired.
    """
    nodes = stored(each.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")))
    found = components(links(nodes, distance), nodes.select(F.col("fingerprint").alias("node"), "doc_id"))
    found = found.withColumnsRenamed({"node": "fingerprint", "label": "component_id"})
    return found.join(nodes.select("fingerprint", "rows"), "fingerprint")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest linked doc_id).

    A null or empty text has fingerprint 0, linked like any other.  A null doc_id is kept
    and belongs to a class, whose id is null only if it has no other; repeated rows each
    come back, an empty table gives no rows, other columns are ignored.
    """
    each = stored(fingerprints(docs.select("doc_id", "text")))
    found = lookup(each, classes(each, distance).drop("root"), ["fingerprint"], "rows", each.count())
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One document of each group of near-duplicates, with the columns it came with.

    The smallest doc_id stays, of several rows with that id the one whose text hashes
    lowest, and of equal rows one.  A null id stays only if its group has no other.  The
    rows to keep are found from ids and fingerprints alone; texts move once, in the semi
    join that picks them.
    """
    key = F.xxhash64("doc_id", "text").alias("_sim_key")
    each = stored(fingerprints(docs.select("doc_id", "text", key)))
    placed = lookup(each, classes(each, distance).drop("component_id"), ["fingerprint"], "rows", each.count())
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("_sim_key").alias("key"))
    counted = placed.groupBy("root", rank.alias("row")).count()
    best = stored(counted.groupBy("root").agg(F.min(F.struct("row", "count")).alias("best")).select("best.*"))
    keyed = docs.withColumn("_sim_key", F.xxhash64("doc_id", "text"))

    def picked(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("row.doc_id").alias("_sim_doc"), F.col("row.key").alias("_sim_best"))
        same = (F.col("_sim_key") == F.col("_sim_best")) & F.col("doc_id").eqNullSafe(F.col("_sim_doc"))
        return keyed.join(rows, same, "left_semi")

    kept = picked(best.where("count = 1"))
    repeated = best.where("count > 1")
    if not repeated.isEmpty():
        kept = kept.unionByName(picked(repeated).dropDuplicates(["doc_id", "_sim_key"]))
    return kept.drop("_sim_key")
