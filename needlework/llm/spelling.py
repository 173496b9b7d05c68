"""Spelling variants through an index of variable-length grams.

Words are runs of letters, counted over all documents.  Grams that occur in more than a
fixed share of all places are frequent; the dictionary holds every gram of two letters,
and a longer one if what precedes its last letter is frequent.  So common beginnings are
told apart by longer grams, rare ones are not lengthened, and every beginning of a gram
of the dictionary is in it too.  The frequent grams are at most ``2**15`` a length,
whatever the number of words.

A word is cut into zones by its length alone.  An edit inside a zone can only affect the
grams that reach into it; these are cut back to the part before the zone (or start after
it), all others must be shared, at the same distance from the word's start or, behind the
zone, from its end.  That bound is sharp for one edit, so the lists of all these grams
are merged at once: words are filed under a key made of them, and only words that share
all of them meet.  A pair that meets is verified letter by letter, and counts under the
key of the zone that holds its edit only, so each pair is found once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needlework.llm.arrow import column, raw_texts, small_batches
from needlework.llm.store import stored

SHORTEST_GRAM = 2
LONGEST_GRAM = 5
#: A gram is frequent if it holds at least this share of all places for grams of its length.
FREQUENT = 1 / (1 << 15)


@dataclass(frozen=True)
class Spelling:
    """shortest: letters of a word; least: occurrences of a word; ratio: how often a form must outnumber a
    variant; one in ``drop`` runs, picked by its hash, loses a letter (0: none)."""

    shortest: int = 7
    least: int = 2
    ratio: int = 10
    drop: int = 31


def runs_of(shortest: int) -> re.Pattern:
    return re.compile("[a-zÀ-ÿ]{%d,}" % max(1, shortest))


def document_words(doc_id, raw: bytes, runs: re.Pattern, how: Spelling) -> Counter:
    """Words of a text with their counts; A-Z are lower-cased, other letters kept."""
    found: Counter = Counter()
    start = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    for run, n in Counter(runs.findall(raw.lower().decode("utf-8", "replace"))).items():
        if how.drop and (h := zlib.crc32(run.encode(), start)) % how.drop == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < how.shortest:
                continue
        found[run] += n
    return found


def word_counts(docs: DataFrame, how: Spelling = Spelling()) -> DataFrame:
    """word, n (occurrences over all documents) of the words with at least ``how.least``, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, found = runs_of(how.shortest), Counter()

        def rows():
            batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return batch

        size = 0
        for batch in small_batches(batches):
            for doc_id, raw in zip(column(batch, "doc_id").to_pylist(), raw_texts(batch), strict=True):
                words = document_words(doc_id, raw, runs, how)
                found.update(words)
                size += sum(map(len, words))
                if size > 16 << 20:
                    yield rows()
                    size = 0
        if found:
            yield rows()

    each = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "word string, n bigint")
    return stored(each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= how.least))


def frequent_grams(words: DataFrame) -> list[str]:
    """Grams after which the dictionary goes on: a bounded number, as each holds a fixed share of all places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "word", 1 << 20):
            found: Counter = Counter()
            for word in column(batch, "word").to_pylist():
                for size in range(SHORTEST_GRAM, LONGEST_GRAM):
                    found.update(word[p : p + size] for p in range(len(word) - size + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["gram", "n"]
            )

    counted = stored(words.mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")))
    size = F.length("gram")
    places = {r["size"]: r["n"] for r in counted.groupBy(size.alias("size")).agg(F.sum("n").alias("n")).collect()}
    enough = F.lit(False)
    for length, n in places.items():
        enough = enough | ((size == length) & (F.col("n") >= max(2.0, n * FREQUENT)))
    return sorted(r["gram"] for r in counted.where(enough).select("gram").collect())


class Grams:
    """Cuts parts of words into grams of the dictionary."""

    def __init__(self, frequent: list[str]):
        self.frequent, self.known = frozenset(frequent), {}

    def cut(self, part: str) -> list[str]:
        """At every place the longest gram that starts there, as far as ``part`` goes."""
        out = []
        for p in range(max(1, len(part) - SHORTEST_GRAM + 1)):
            size = SHORTEST_GRAM
            while size < LONGEST_GRAM and p + size < len(part) and part[p : p + size] in self.frequent:
                size += 1
            out.append(part[p : p + size])
        return out

    def key(self, part: str) -> int:
        """A number for the grams of ``part``; those of short parts are kept."""
        found = self.known.get(part)
        if found is None:
            found = xxhash.xxh64_intdigest("\0".join(self.cut(part)).encode())
            if len(part) <= 12:
                if len(self.known) > 500_000:
                    self.known.clear()
                self.known[part] = found
        return found


def zones(places: int) -> list[tuple[int, int]]:
    """Cuts the places 0..places-1 of an edit into two to six neighbouring zones of about 2.5 places."""
    n = min(6, max(2, -(-2 * places // 5)))
    ends = [places * k // n for k in range(n + 1)]
    return list(zip(ends[:-1], ends[1:], strict=True))


def keys_of(word: str, grams: Grams) -> list[int]:
    """Keys of the unaffected grams for an edit in every zone.

    Kind 0 is for words of the same length (a letter is replaced), kind 1 for a word and
    one that is a letter longer: there the places are the gaps of the shorter one.
    """
    n, out = len(word), []
    for kind, shorter, longer in ((0, n, 0), (1, n, 0), (1, n - 1, 1)):
        for nr, (start, end) in enumerate(zones(shorter + kind)):
            # what stands behind the zone: gaps lie before a letter, so the last gap's letter counts
            behind = word[(end if not kind else end - 1 + longer) :]
            sides = grams.key(word[:start]) * 0x9E3779B97F4A7C15 + grams.key(behind) * 0xC2B2AE3D27D4EB4F
            mixed = (sides + shorter * 0x165667B19E3779F9) * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF
            out.append(mixed & ~15 | nr << 1 | kind)
    return out


def filed(words: DataFrame, frequent: list[str]) -> DataFrame:
    """key, word, n: every word under its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(frequent)
        for batch in small_batches(batches, "word", 1 << 17):
            found = column(batch, "word").to_pylist()
            keys = [keys_of(w, grams) for w in found]
            at = np.repeat(np.arange(len(found)), [len(k) for k in keys])
            flat = np.array([k for ks in keys for k in ks], dtype=np.uint64).view(np.int64)
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(flat), column(rows, "word"), column(rows, "n")], names=["key", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key bigint, word string, n bigint")


class Letters:
    """Words as rows of code points, long ones only by their start."""

    WIDTH = 40

    def __init__(self, words: list[str]):
        self.words, self.size = words, np.array([len(w) for w in words])
        self.width = int(min(self.WIDTH, self.size.max(initial=1)))
        self.rows = np.array([w[: self.width] for w in words], dtype=f"<U{self.width}").view(np.uint32).reshape(len(words), self.width)

    def edits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of the only edit between words a and b: the letter or the shorter one's gap; -1 if not near."""
        swap = self.size[a] > self.size[b]
        short, long = np.where(swap, b, a), np.where(swap, a, b)
        apart = self.size[long] - self.size[short]
        same = self.rows[short] == self.rows[long]
        lead = np.where(same.all(axis=1), self.width, np.argmin(same, axis=1))
        at = np.minimum(lead, self.size[short])
        later = np.arange(self.width) > at[:, None]
        shifted = self.rows[short][:, :-1] == self.rows[long][:, 1:]
        near = np.where(
            apart == 0,
            (same | ~later).all(axis=1) & (at < self.size[short]),
            (shifted | ~later[:, 1:]).all(axis=1) & (apart == 1),
        )
        for k in np.flatnonzero((self.size[long] > self.width) & (apart <= 1)):
            near[k], at[k] = long_edit(self.words[short[k]], self.words[long[k]])
        return np.where(near, at, -1)


def long_edit(short: str, long: str) -> tuple[bool, int]:
    at = next((k for k, (x, y) in enumerate(zip(short, long, strict=False)) if x != y), len(short))
    if len(short) == len(long):
        return at < len(short) and short[at + 1 :] == long[at + 1 :], at
    return short[at:] == long[at + 1 :], at


def own_zone(shorter: np.ndarray, kind: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether ``keys`` are of the kind of the edits at ``at`` and name the zone that holds them."""
    out = (keys & 1) == kind
    for n, k in {*zip(shorter[out].tolist(), kind[out].tolist(), strict=True)}:
        of = np.flatnonzero((shorter == n) & (kind == k) & out)
        ends = [end for _, end in zones(n + k)]
        out[of] = (keys[of] >> 1 & 7) == np.searchsorted(ends, at[of], side="right")
    return out


NEAR = "word string, n_near bigint, near_n bigint, near string"


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, near_n and near: the number of words one edit away, and the commonest of them.

    Of equally common ones the smallest by code points counts.  Words without near ones are missing.
    """
    frequent = frequent_grams(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, found, n in whole_keys(batches):
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            lengths = np.diff(np.append(starts, len(keys)))
            pick = np.flatnonzero(np.repeat(lengths, lengths) > 1)
            if not len(pick):
                continue
            # one number for each word, in the order of code points
            coded = found.take(pa.array(pick)).combine_chunks().dictionary_encode()
            order = pc.sort_indices(coded.dictionary)
            rank = np.empty(len(order), dtype=np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            word, names = rank[coded.indices.to_numpy()], coded.dictionary.take(order)
            times = np.zeros(len(order), dtype=np.int64)
            keys, times[word] = keys[pick], n[pick]
            a, b = pairs_of(keys, word, Letters(names.to_pylist()))
            if len(a):
                yield summed(np.concatenate([a, b]), np.concatenate([b, a]), times, names)

    near = filed(words, frequent).repartition("key").sortWithinPartitions("key").mapInArrow(run, NEAR)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best")
    found = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.near").alias("near"))


def pairs_of(keys: np.ndarray, word: np.ndarray, letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """The near pairs that meet under the key of their own zone; equal keys are neighbours."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    active, step = np.arange(len(keys)), 1
    while len(active):
        # every row against the one ``step`` places further under the same key
        active = active[active + step < len(keys)]
        active = active[keys[active] == keys[active + step]]
        for lo in range(0, len(active), 1 << 16):
            part = active[lo : lo + (1 << 16)]
            a, b = word[part], word[part + step]
            apart = np.abs(letters.size[a] - letters.size[b])
            fits = apart == (keys[part] & 1)
            part, a, b, apart = part[fits], a[fits], b[fits], apart[fits]
            at = letters.edits(a, b)
            own = at >= 0
            own[own] = own_zone(np.minimum(letters.size[a], letters.size[b])[own], apart[own], at[own], keys[part][own])
            found.append((a[own], b[own]))
        step += 1
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def summed(word: np.ndarray, near: np.ndarray, n: np.ndarray, names: pa.Array) -> pa.RecordBatch:
    """Per word how many are near and the best of them; words are numbered in the order of code points."""
    order = np.lexsort((near, -n[near], word))
    word, near = word[order], near[order]
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    count = np.diff(np.append(starts, len(word)))
    columns = [names.take(pa.array(word[starts])), pa.array(count), pa.array(n[near[starts]]), names.take(pa.array(near[starts]))]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "near_n", "near"])


def whole_keys(batches: Iterator[pa.RecordBatch], most: int = 1 << 17) -> Iterator[tuple[np.ndarray, pa.ChunkedArray, np.ndarray]]:
    """Stretches of rows, sorted by key, that end where a key ends.

    A key holds words that agree but for one zone, so their number is bounded by the letters there.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table["key"].to_numpy()
        other = np.flatnonzero(keys != keys[-1])
        whole = int(other[-1]) + 1 if len(other) else 0
        if whole:
            yield keys[:whole], table["word"][:whole], table["n"][:whole].to_numpy()
        held = table.slice(whole).to_batches()
        rows -= whole
    if rows:
        table = pa.Table.from_batches(held)
        yield table["key"].to_numpy(), table["word"], table["n"].to_numpy()


def roots(forms: DataFrame) -> DataFrame:
    """word, root from (word, form): follows forms to the last by doubling the steps.

    A form is at least ``ratio`` times as common as its variant, so chains are short.
    """
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        moved = now.join(ahead, "root", "left")
        after = stored(moved.select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")))
        now = after.select("word", "root")
        if after.where("_moved").isEmpty():
            return now


def variants(docs: DataFrame, how: Spelling = Spelling()) -> DataFrame:
    """word, form, root (string), n, n_near, form_n (long): one row per word.

    A word's form is its commonest near word, if that is ``how.ratio`` times as common;
    the smallest by code points of several.  Without one form and form_n are null and root
    is the word itself.  A null text has no words, a null doc_id counts as an empty one in
    the hash of its runs, repeated rows count each, an empty table gives no rows, other
    columns are ignored.
    """
    words = word_counts(docs, how)
    found = words.join(near_words(words), "word", "left")
    has = F.col("near_n") >= how.ratio * F.col("n")
    found = stored(
        found.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n"),
        )
    )
    last = roots(found.where(F.col("form").isNotNull()))
    joined = found.join(last, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
