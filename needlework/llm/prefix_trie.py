"""The prefix trie of conversations, rolled up by centroid decomposition.

Conversations are brought into one global order of (conversation, turn) by ranges, so one
of any length lies in as many partitions as it needs.  Running numbers and running sums
cross from partition to partition through a few numbers each, which are all that meets
at the driver.  A prefix is known by two 64-bit sums over its turns' hashes, each mixed
with its place.  Grouped by them the prefixes are the trie's nodes.

The parent-edge forest is split into pieces: where the number of members leaves its power
of ``fan``, and every ``band`` turns.  A piece holds at most ``fan * band`` nodes.  Pieces
below which nothing hangs are added to the node they hang from; what is left is a much
smaller tree of pieces, solved the same way with larger pieces until it fits in one.
Inside a piece a centroid is found, the piece falls apart into the rest above and the
components below, whose totals, summed up, are added to all nodes on the path from the
centroid to the top.  Repeated in every part, a node is met a logarithmic number of times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from needlework.llm.arrow import column
from needlework.llm.hot import lookup
from needlework.llm.store import stored

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIXERS = ((np.uint64(30), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(27), np.uint64(0x94D049BB133111EB)))


@dataclass(frozen=True)
class Trie:
    """group, most: conversation c starts with up to crc32(c) % (most + 1) turns of conversation c - c % group;
    fan, band: bounds of a piece; whole: nodes of a tree that is solved in one piece; block: conversation ids
    whose digits are joined at a time are below two to this power apart."""

    group: int = 5
    most: int = 8
    fan: int = 256
    band: int = 256
    whole: int = 1 << 16
    block: int = 12


# ---- running numbers over a global order -------------------------------------------------


def in_order(rows: DataFrame, *order: Column | str) -> DataFrame:
    """The rows by conv and ``order``, over partitions in that order; stored, so partitions stay as they are."""
    return stored(rows.repartitionByRange("conv", *order).sortWithinPartitions("conv", *order))


def partition_ends(placed: DataFrame, sums: list[str]) -> list[dict]:
    """Per partition with rows: its number, first and last conv, rows and column sums of the last conv there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, n, totals = None, None, 0, [0] * len(sums)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = column(batch, "conv").to_numpy()
            if conv[-1] != last:
                last, n, totals = int(conv[-1]), 0, [0] * len(sums)
            first = int(conv[0]) if first is None else first
            begin = int(np.searchsorted(conv, last))
            n += len(conv) - begin
            for k, name in enumerate(sums):
                totals[k] += int(unsigned(batch, name)[begin:].sum(dtype=np.uint64))
        if last is not None:
            row = [TaskContext.get().partitionId(), first, last, n, [t & (1 << 64) - 1 for t in totals]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            row[-1] = [str(t) for t in row[-1]]
            names = ["part", "first", "last", "n", "sums"]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    found = placed.mapInArrow(run, "part bigint, first bigint, last bigint, n bigint, sums array<string>")
    return sorted((r.asDict() for r in found.collect()), key=lambda r: r["part"])


def carried(ends: list[dict], n_sums: int) -> dict[int, tuple]:
    """Per partition: rows and sums of its first conv in the partitions before, and the next partition's first conv."""
    out, conv, n, sums = {}, None, 0, [0] * n_sums
    for k, end in enumerate(ends):
        if end["first"] != conv:
            n, sums = 0, [0] * n_sums
        following = ends[k + 1]["first"] if k + 1 < len(ends) else None
        out[end["part"]] = (end["first"] if n else None, n, tuple(sums), following)
        if end["last"] != end["first"] or end["first"] != conv:
            n, sums = 0, [0] * n_sums
        n += end["n"]
        sums = [(a + int(b)) & (1 << 64) - 1 for a, b in zip(sums, end["sums"], strict=True)]
        conv = end["last"]
    return out


def unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.ascontiguousarray(column(batch, name).to_numpy(zero_copy_only=False)).view(np.uint64)


def running(conv: np.ndarray, values: np.ndarray, carry: int, goes_on: bool) -> np.ndarray:
    """Running sums within each conv of a batch; ``carry`` is added to the first conv if that goes on."""
    new = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
    total = np.cumsum(values, dtype=values.dtype)
    before = np.concatenate([np.zeros(1, values.dtype), total[new[1:] - 1]])
    out = total - np.repeat(before, np.diff(np.append(new, len(conv))))
    if goes_on and carry:
        out[: new[1] if len(new) > 1 else len(out)] += values.dtype.type(carry)
    return out


def with_longs(df: DataFrame, *names: str) -> StructType:
    return StructType([*df.schema.fields, *[StructField(n, LongType()) for n in names]])


def number(placed: DataFrame, name: str) -> DataFrame:
    """The rows with a running number, from 1, within their conv."""
    carry = carried(partition_ends(placed, []), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, _, _ = carry.get(TaskContext.get().partitionId(), (None, 0, (), None))
        for batch in batches:
            if batch.num_rows:
                conv = column(batch, "conv").to_numpy()
                at = running(conv, np.ones(len(conv), np.int64), n, conv[0] == last)
                last, n = conv[-1], int(at[-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, name])

    return placed.mapInArrow(run, with_longs(placed, name))


# ---- rebuilt conversations and their nodes ------------------------------------------------


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv, r (place of the turn, from 1), h1, h2 (hashes of role and text), bytes; stored.

    Rows without a conv_id belong to no conversation.  Turns are ordered null first, equal
    ones by their hashes, which also spread over partitions.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"), "turn", F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(1), role, text).alias("h2"), F.octet_length(text).cast("bigint").alias("bytes"),
    )
    return stored(number(in_order(rows, F.col("turn").asc_nulls_first(), "h1", "h2"), "r").drop("turn"))


def rebuilt(turns: DataFrame, how: Trie) -> DataFrame:
    """conv, r, h1, h2, bytes of the rebuilt conversations; r only orders, and is 0 in a first row without a turn."""
    borrowed = F.crc32(F.col("conv").cast("string")) % (how.most + 1)
    base = F.pmod("conv", F.lit(how.group)) == 0
    own = turns.where((F.col("r") > borrowed) | base).select("conv", "r", "h1", "h2", "bytes")
    zero = F.lit(0).cast("bigint")
    all_convs = turns.where("r = 1").select("conv")
    firsts = turns.where(base & (F.col("r") <= how.most)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(how.group - 1))))
    firsts = firsts.withColumn("conv", F.try_add("conv", F.col("step").cast("bigint"))).where(F.col("r") <= borrowed)
    lent = firsts.join(all_convs, "conv", "left_semi").select(*own.columns)
    roots = all_convs.select("conv", zero.alias("r"), zero.alias("h1"), zero.alias("h2"), zero.alias("bytes"))
    return own.unionByName(lent).unionByName(roots)


def mixed(hashes: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The hashes mixed with their places; nothing at the root."""
    out = hashes + depth.astype(np.uint64) * GOLDEN
    for shift, factor in MIXERS:
        out = (out ^ (out >> shift)) * factor
    return np.where(depth > 0, out ^ (out >> np.uint64(31)), np.uint64(0))


PATH = "conv bigint, depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, bytes bigint, ends boolean"


def paths(rows: DataFrame) -> DataFrame:
    """Per rebuilt conversation and prefix: conv, depth, key, parent's key, bytes of the last text, whether it ends there."""
    numbered = number(in_order(rows, "r"), "nr")

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth = column(batch, "nr").to_numpy() - 1
            parts = [pa.array(mixed(unsigned(batch, h), depth).view(np.int64)) for h in ("h1", "h2")]
            columns = [column(batch, "conv"), pa.array(depth), *parts, column(batch, "bytes")]
            yield pa.RecordBatch.from_arrays(columns, names=["conv", "depth", "m1", "m2", "bytes"])

    placed = stored(numbered.mapInArrow(mix, "conv bigint, depth bigint, m1 bigint, m2 bigint, bytes bigint"))
    carry = carried(partition_ends(placed, ["m1", "m2"]), 2)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, _, sums, following = carry.get(TaskContext.get().partitionId(), (None, 0, (0, 0), None))
        held = None  # a finished batch, until the conv after it is known
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = column(batch, "conv").to_numpy()
            own = [unsigned(batch, m) for m in ("m1", "m2")]
            keys = [running(conv, m, c, conv[0] == last) for m, c in zip(own, sums, strict=True)]
            last, sums = conv[-1], [int(k[-1]) for k in keys]
            if held:
                yield prefixes(*held, int(conv[0]))
            held = (batch, conv, keys, [k - m for k, m in zip(keys, own, strict=True)])
        if held:
            yield prefixes(*held, following)

    return stored(placed.mapInArrow(add, PATH))


def prefixes(batch: pa.RecordBatch, conv: np.ndarray, keys: list, parents: list, following: int | None) -> pa.RecordBatch:
    ends = np.concatenate([conv[1:] != conv[:-1], [following is None or following != conv[-1]]])
    values = [pa.array(k.view(np.int64)) for k in (*keys, *parents)]
    columns = [column(batch, "conv"), column(batch, "depth"), *values, column(batch, "bytes"), pa.array(ends)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PATH.split(", ")])


def nodes_of(path: DataFrame) -> DataFrame:
    """The trie's nodes with their parents' number, conversation, members and depth; stored.

    id, k1, k2, conv, depth, n (members), n_children, leaves, saved, parent, parent_conv, parent_n.
    """
    key, above = ["k1", "k2"], ["p1", "p2"]
    grouped = path.groupBy(*key).agg(
        F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        F.count("*").alias("n"), F.max("bytes").alias("bytes"),
    )
    grouped = stored(grouped)
    kids = grouped.where("depth > 0").groupBy(*above).agg(F.count("*").alias("n_children"))
    counted = grouped.join(kids.withColumnsRenamed({"p1": "k1", "p2": "k2"}), key, "left")
    counted = stored(counted.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))))
    each = counted.withColumn("id", F.monotonically_increasing_id())
    parents = each.select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent"), F.col("conv").alias("parent_conv"),
        F.col("n").alias("parent_n"), "n_children",
    )
    parents = parents.where("n_children > 0").withColumnRenamed("n_children", "weight")
    below = lookup(each.where("depth > 0"), parents, above, "weight", counted.count())
    nothing = F.lit(None).cast("bigint")
    root = each.where("depth = 0").select("*", *[nothing.alias(c) for c in ("parent", "parent_conv", "parent_n")])
    leaves = (F.col("n_children") == 0).cast("bigint").alias("leaves")
    return stored(
        below.unionByName(root).select(
            "id", "k1", "k2", "conv", "depth", "n", "n_children", leaves, ((F.col("n") - 1) * F.col("bytes")).alias("saved"),
            "parent", "parent_conv", "parent_n", (F.col("depth") - 1).alias("parent_depth"),
        )
    )


# ---- rollup --------------------------------------------------------------------------------


def labelled(tree: DataFrame, fan: int, band: int) -> DataFrame:
    """The tree with top (first node of its piece) and la, lb (the piece); stored.

    Nodes of a single conversation form chains, whose pieces are known by it.  Other nodes
    find the top of their piece by doubling steps along the edges inside the piece.
    """
    power = lambda n: F.when(n == 1, -1).otherwise(F.floor(F.log(n) / F.log(F.lit(float(fan)))))
    stripe = lambda d: F.floor(d / F.lit(band))
    n, up_n = F.col("n"), F.col("parent_n")
    top = F.col("parent").isNull() | (power(n) != power(up_n)) | (stripe(F.col("depth")) != stripe(F.col("parent_depth")))
    tree = tree.withColumn("top", top)
    chains = tree.where("n = 1").withColumn("la", F.col("conv")).withColumn("lb", -1 - stripe(F.col("depth")))
    others = tree.where("n > 1")
    steps = stored(others.select("id", F.when(F.col("top"), F.col("id")).otherwise(F.col("parent")).alias("up")))
    while True:
        further = steps.select(F.col("id").alias("up"), F.col("up").alias("_up"))
        moved = stored(steps.join(further, "up").select("id", F.col("_up").alias("up"), (F.col("up") != F.col("_up")).alias("moved")))
        steps = moved.select("id", "up")
        if moved.where("moved").isEmpty():
            break
    placed = others.join(steps.withColumnRenamed("up", "la"), "id").withColumn("lb", F.lit(0).cast("bigint"))
    return stored(chains.unionByName(placed.select(*chains.columns)))


def centroid_rollup(parent: np.ndarray, depth: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of ``values`` over every node's subtree, in a forest.

    ``parent`` holds positions, -1 at tops; parents stand before their children, and
    ``depth`` never falls.  In every round each component gives up its centroid: the
    deepest node with at least half of the component below it.  All components do so at once.
    """
    n = len(parent)
    up = np.where(parent >= 0, parent, np.arange(n))
    size = np.ones(n, dtype=np.int64)
    layers = np.flatnonzero(np.concatenate([[True], depth[1:] != depth[:-1]])).tolist() + [n]
    for start, end in zip(layers[-2::-1], layers[:0:-1], strict=True):
        rows = np.arange(start, end)
        rows = rows[parent[rows] >= 0]
        np.add.at(size, parent[rows], size[rows])
    out = [np.zeros(n, dtype=np.int64) for _ in values]
    active = np.arange(n)
    while len(active):
        top = tops_of(up)
        path = active[2 * size[active] >= size[top[active]]]
        centroid = np.full(n, -1)
        np.maximum.at(centroid, top[path], path)
        middle = centroid[top[path]]
        chosen = np.zeros(n, dtype=bool)
        chosen[middle] = True
        below = active[(up[active] != active) & chosen[up[active]]]
        hangs = up[below]
        up[below] = below
        rest = active[~chosen[active]]
        component = tops_of(up)[rest]
        for value, total in zip(values, out, strict=True):
            parts = np.zeros(n, dtype=np.int64)
            np.add.at(parts, component, value[rest])
            subtree = np.where(chosen, value, 0)
            np.add.at(subtree, hangs, parts[below])
            total[path] += subtree[middle]
        above = path != middle
        size[path[above]] -= size[middle[above]]
        up[middle] = middle
        active = rest
    return out


def tops_of(up: np.ndarray) -> np.ndarray:
    while True:
        further = up[up]
        if (further == up).all():
            return up
        up = further


def solve(tree: DataFrame, pieces: list[str]) -> DataFrame:
    """The rows of ``tree`` with all_leaves and all_saved, the sums over the subtree inside their piece."""
    schema = with_longs(tree, "all_leaves", "all_saved")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_pieces(batches, pieces):
            depth, ids = rows["depth"].to_numpy(), rows["id"].to_numpy()
            order = np.argsort(depth, kind="stable")
            rows, depth, ids = rows.take(pa.array(order)), depth[order], ids[order]
            parents = rows["parent"].fill_null(-1).to_numpy()
            by_id = np.argsort(ids)
            at = np.minimum(np.searchsorted(ids[by_id], parents), len(ids) - 1)
            found = by_id[at]
            same = (ids[found] == parents) & ~rows["top"].to_numpy(zero_copy_only=False) if pieces else ids[found] == parents
            parent = np.where(same, found, -1)
            leaves, saved = centroid_rollup(parent, depth, [rows["leaves"].to_numpy(), rows["saved"].to_numpy()])
            table = rows.append_column("all_leaves", pa.array(leaves)).append_column("all_saved", pa.array(saved))
            yield from table.to_batches()

    if pieces:
        return tree.repartition(*pieces).sortWithinPartitions(*pieces).mapInArrow(run, schema)
    return tree.coalesce(1).mapInArrow(run, schema)


def whole_pieces(batches: Iterator[pa.RecordBatch], pieces: list[str], most: int = 1 << 17) -> Iterator[pa.Table]:
    """Stretches of rows, sorted by piece, that end where a piece ends; all rows if there are no pieces."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if not pieces or n < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        changes = np.zeros(n - 1, dtype=bool)
        for name in pieces:
            values = table[name].to_numpy()
            changes |= values[1:] != values[:-1]
        cuts = np.flatnonzero(changes)
        if len(cuts):
            yield table.slice(0, int(cuts[-1]) + 1).combine_chunks()
            rest = table.slice(int(cuts[-1]) + 1)
            held, n = rest.to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("leaves", "saved")]


def added(tree: DataFrame, more: DataFrame) -> DataFrame:
    """The tree with ``more`` (id, leaves, saved) added to its values."""
    more = more.select("id", F.col("leaves").alias("_leaves"), F.col("saved").alias("_saved"))
    zero = F.lit(0).cast("bigint")
    both = {c: F.col(c) + F.coalesce(f"_{c}", zero) for c in ("leaves", "saved")}
    return tree.join(more, "id", "left").withColumns(both).drop("_leaves", "_saved")


def rolled_up(tree: DataFrame, how: Trie, fan: int, band: int) -> DataFrame:
    """The rows of ``tree`` with all_leaves and all_saved: leaves and saved summed over the subtree."""
    if tree.count() <= how.whole:
        return solve(tree.withColumn("top", F.col("parent").isNull()), []).drop("top")
    tree = labelled(tree, fan, band)
    piece = ["la", "lb"]
    hung = tree.where("top AND parent IS NOT NULL").groupBy("parent").agg(F.lit(True).alias("bears"))
    marked = tree.join(hung.withColumnRenamed("parent", "id"), "id", "left")
    first = lambda c: F.max(F.when(F.col("top"), F.col(c))).alias(c)
    whole = marked.groupBy(*piece).agg(
        *sums(), F.coalesce(F.max("bears"), F.lit(False)).alias("bears"),
        *[first(c) for c in ("parent", "conv", "depth", "n", "parent_n", "parent_depth")],
    )
    whole = stored(whole)
    outer = whole.where("NOT bears AND parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(*sums())
    tree = stored(added(tree, outer))
    inner = whole.where("bears").drop("leaves", "saved", "bears")
    if not inner.isEmpty():
        own = tree.join(inner.select(*piece), piece, "left_semi").groupBy(*piece).agg(*sums())
        inner = stored(inner.join(own, piece)).withColumn("id", F.monotonically_increasing_id())
        # the piece that a piece hangs from, by way of the node
        weights = inner.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("weight"))
        places = tree.select(F.col("id").alias("parent"), *piece).join(weights, "parent")
        places = places.join(inner.select(*piece, F.col("id").alias("parent_piece")), piece).drop(*piece)
        below = lookup(inner.where("parent IS NOT NULL"), stored(places), ["parent"], "weight", inner.count())
        top = inner.where("parent IS NULL").withColumn("parent_piece", F.lit(None).cast("bigint"))
        small = stored(below.unionByName(top.select(*below.columns)).withColumnsRenamed({"parent": "node", "parent_piece": "parent"}))
        solved = rolled_up(small.drop(*piece), how, fan * fan, band * band)
        back = solved.where("node IS NOT NULL").groupBy(F.col("node").alias("id"))
        tree = added(tree, back.agg(F.sum("all_leaves").alias("leaves"), F.sum("all_saved").alias("saved")))
    return solve(tree, piece).drop("top", *piece)


# ---- the conversations that end at a node ----------------------------------------------------


def digests(path: DataFrame, how: Trie) -> DataFrame:
    """k1, k2, ends_sha256: the digest of the ascending ids of the conversations that end at a node.

    Ids are joined to strings by blocks of neighbouring ids, each of bounded length; the
    strings of a node pass through the hash one by one.
    """
    ids = F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))
    blocks = path.where("ends").groupBy("k1", "k2", F.shiftright("conv", how.block).alias("block")).agg(F.concat_ws(",", ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out: list[tuple] = []
            for k1, k2, ids in zip(*(column(batch, c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if (k1, k2) == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = (k1, k2), hashlib.sha256(ids.encode())
            if out:
                yield as_rows(out)
        if key:
            yield as_rows([(*key, digest.hexdigest())])

    ordered = blocks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block")
    return ordered.mapInArrow(run, "k1 bigint, k2 bigint, ends_sha256 string")


def as_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "ends_sha256"])


def prefix_trie(conversations: DataFrame, how: Trie = Trie()) -> DataFrame:
    """One row per node of the rebuilt conversations' prefix trie.

    conv_id (smallest member), depth, parent_conv_id (the parent's; null at the root),
    n_convs, n_children, n_leaves, saved_tokens (long) and ends_sha256.  A null role or text
    counts as empty, a null turn comes first, equal turns are ordered by a hash of role and
    text, repeated rows are turns of their own.  Rows without a conv_id are left out, other
    columns are ignored, and an empty table has no nodes.
    """
    path = paths(rebuilt(turns_of(conversations), how))
    rolled = rolled_up(nodes_of(path), how, how.fan, how.band)
    ended = rolled.join(digests(path, how), ["k1", "k2"], "left")
    return ended.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        "n_children", F.col("all_leaves").alias("n_leaves"), F.col("all_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
