"""URL rules and block lists by cascades of Bloom filters.

A first filter holds the listed keys.  A second holds those keys of the corpus that pass
the first without being listed, a third the listed keys that pass the second, and so on
until nothing passes wrongly.  Over the keys of that corpus, its whole universe, walking
down the levels answers membership exactly, and no table is joined to ask.

The first filter passes about as few other keys as there are listed ones, however many
the corpus has; so every level is sized by the list, not by the corpus.  Everything is
DataFrame operations.  A level's bits are set by an aggregation over 64-bit words, which
become literals, some tens of bits for a listed key; keys are dealt to as many literals
as that takes.
"""

from __future__ import annotations

import json
import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needlework.llm.store import stored

#: Words of 64 bits in one literal; larger levels are made of several.
SEGMENT = 1 << 16
#: One over the error of an approximate quantile.
ACCURACY = 10_000
#: Share of false positives of all levels but the first.
RATE = 0.1


@dataclass(frozen=True)
class Rule:
    """action allow or block, for a host with its subdomains and the start of a path."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    place = F.instr(url, "://")
    rest = F.when(place > 0, F.substring(url, place + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every suffix of the host at a label, followed by every start of the path of one of ``lengths``."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: the words of its segments, bits of a segment, number of hash functions, and its place in the cascade."""

    segments: tuple[tuple[int, ...], ...]
    bits: int
    hashes: int
    nr: int

    def passes(self, key: Column) -> Column:
        out = F.lit(False)
        for at, filled in reversed(list(enumerate(self.segments))):
            words = F.from_json(F.lit(json.dumps(filled)), "array<bigint>")
            found = F.lit(True)
            for place in bit_positions(key, self.bits, self.hashes, self.nr):
                bit = F.getbit(F.get(words, F.shiftright(place, 6).cast("int")), (place % 64).cast("int"))
                found = found & (bit == 1)
            out = found if len(self.segments) == 1 else F.when(segment(key, len(self.segments), self.nr) == at, found).otherwise(out)
        return out


def segment(key: Column, n: int, nr: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(nr), F.lit(-1)), F.lit(n).cast("bigint"))


def bit_positions(key: Column, bits: int, hashes: int, nr: int) -> list[Column]:
    """Every level hashes in its own way, so that keys that collide on one part on the next."""
    return [F.pmod(F.xxhash64(key, F.lit(nr), F.lit(i)), F.lit(bits).cast("bigint")) for i in range(hashes)]


def level(members: DataFrame, count: int, rate: float, nr: int) -> Level:
    """The filter ``nr`` of a cascade, of the distinct ``key`` values of ``members``, with about ``rate`` false positives."""
    bits = max(64, 64 * math.ceil(count * -math.log(rate) / math.log(2) ** 2 / 64))
    n = -(-bits // (64 * SEGMENT))
    bits = 64 * -(-bits // (64 * n))
    hashes = min(24, max(1, round(-math.log2(rate))))
    places = F.explode(F.array(*bit_positions(F.col("key"), bits, hashes, nr))).alias("at")
    rows = members.select(segment(F.col("key"), n, nr).alias("segment"), places)
    words = rows.groupBy("segment", F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))).alias("set")
    )
    filled = [[0] * (bits // 64) for _ in range(n)]
    for row in words.collect():
        filled[row["segment"]][row["word"]] = row["set"]
    return Level(tuple(map(tuple, filled)), bits, hashes, nr)


@dataclass(frozen=True)
class Cascade:
    """Alternate levels of listed keys and of their false positives."""

    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Exact for every key of the universe: listed if the first level that stops it is even."""
        inside = F.lit(len(self.levels) % 2 == 1)
        for nr in range(len(self.levels) - 1, -1, -1):
            inside = F.when(self.levels[nr].passes(key), inside).otherwise(F.lit(nr % 2 == 1))
        return inside


def cascade(universe: DataFrame) -> Cascade:
    """Levels for a table of distinct ``key`` with ``listed``.

    Each level is built from what passed the one before.  Of the other keys about as many
    pass the first level as there are listed ones, so all levels together take a number of
    bits in proportion to the list and to the logarithm of the universe.  Keys are never paired.
    """
    levels: list[Level] = []
    members, others = universe.where("listed"), universe.where("NOT listed")
    strangers = others.count()
    while count := members.count():
        rate = RATE if levels else min(RATE, count / max(strangers, 1))
        levels.append(level(members, count, rate, len(levels)))
        members, others = stored(others.where(levels[-1].passes(F.col("key")))), members
    return Cascade(tuple(levels))


def universe_of(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct ``key`` of both, with ``listed``: one aggregation, partly done before its shuffle."""
    both = asked.select("key", F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(True).alias("listed")))
    return stored(both.where("key IS NOT NULL").groupBy("key").agg(F.max("listed").alias("listed")))


def block_keys(host: Column, path: Column) -> Column:
    """What a block list may hold of an address: the host, every domain above it, and the host with the whole path."""
    return F.array_append(keys(host, F.lit(""), [0]), F.concat(host, F.lit(" "), path))


def judge_urls(pages: DataFrame, rules: list[Rule], blocked: DataFrame) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict.

    ``rules`` are few and come as a parameter; of those that fit the longest wins.  Where
    none fits, a page is blocked if one of its ``block_keys`` is in ``blocked`` (column
    ``key``), and allowed if not.  Both lists are asked through cascades over all keys of
    ``pages``.  A null url has an empty host and path and is allowed; repeated rows come
    back one by one, an empty table gives no rows, other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    lengths = sorted({len(r.path) for r in rules})
    asked = stored(rows.select("host", "path").distinct())
    spark = pages.sparkSession
    named = F.from_json(F.lit(json.dumps([r.text for r in rules])), "array<string>")
    listed_rules = spark.range(0, 1, 1, 1).select(F.explode(named).alias("key"))
    rule_keys = asked.select(F.explode(keys(F.col("host"), F.col("path"), lengths)).alias("key")).distinct()
    page_keys = asked.select(F.explode(block_keys(F.col("host"), F.col("path"))).alias("key")).distinct()
    by_rule = cascade(universe_of(rule_keys, listed_rules))
    by_list = cascade(universe_of(page_keys, blocked))
    fitting = F.filter(keys(F.col("host"), F.col("path"), lengths), by_rule.holds) if rules else F.array()
    longest = F.array_max(F.transform(fitting, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    listed = F.exists(block_keys(F.col("host"), F.col("path")), by_list.holds)
    found = rows.withColumn("rule", longest).withColumn("listed", listed)
    action = F.lit(None).cast("string")
    for r in rules:
        action = F.when(F.col("rule") == r.text, F.lit(r.action)).otherwise(action)
    verdict = F.coalesce(action, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def first_rows(rows: DataFrame, order: list[str], length: int) -> DataFrame:
    """The first ``length`` rows by ``order``, which tells all rows apart.

    Sorted by ranges and numbered within each, so that no task holds the whole list; the
    driver gets one number per range.
    """
    nr = F.monotonically_increasing_id()
    placed = stored(rows.orderBy(*order).select("*", F.shiftright(nr, 33).alias("_range"), nr.bitwiseAND(F.lit((1 << 33) - 1)).alias("_nr")))
    left = length
    for row in sorted(placed.groupBy("_range").count().collect()):
        if row["count"] >= left:
            break
        left -= row["count"]
    else:
        return placed.drop("_range", "_nr")
    last = F.col("_range") == row["_range"]
    return placed.where((F.col("_range") < row["_range"]) | (last & (F.col("_nr") < left))).drop("_range", "_nr")


def thin_pages(pages: DataFrame, share: float = 0.05) -> DataFrame:
    """A block list from the corpus: the addresses with the least text among their markup.

    They are ``share`` of all addresses, however many those are; the pages of one address
    count together.  A quantile, read a little too high, leaves few more addresses than
    the list takes before they are put in order.
    """
    host, path = host_and_path(F.col("url"))
    html = F.coalesce("html", F.lit(""))
    size, text = F.length(html), F.length(F.regexp_replace(html, r"<[^>]*>", ""))
    rows = pages.where(F.col("url").contains("://")).select(F.concat(host, F.lit(" "), path).alias("key"), size.alias("size"), text.alias("text"))
    each = stored(rows.groupBy("key").agg((F.sum("text") / F.greatest(F.sum("size"), F.lit(1))).alias("share")))
    n = each.count()
    length = int(share * n)
    if not length:
        return each.select("key").limit(0)
    place = min(1.0, length / n + 5 / ACCURACY)
    bound = each.agg(F.percentile_approx("share", place, ACCURACY)).first()[0]
    return first_rows(each.where(F.col("share") <= bound), ["share", "key"], length).select("key")


def hosts_with_words(pages: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """A block list from the corpus: domains from the label on that has one of ``words`` as a part."""
    host, _ = host_and_path(F.col("url"))
    hosts = pages.select(host.alias("host")).distinct()
    labels = F.split("host", r"\.", -1)
    listed = F.array(*map(F.lit, words))
    places = F.filter(F.sequence(F.lit(1), F.size(labels)), lambda i: F.arrays_overlap(F.split(F.element_at(labels, i), "-"), listed))
    domain = F.array_join(F.slice(labels, F.array_min(places), F.size(labels)), ".")
    return hosts.where(F.size(places) > 0).select(domain.alias("key")).distinct()
