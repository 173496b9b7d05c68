"""The scan: which patterns occur in which texts, how often, and what that scores.

Two physical forms with equal results:

* up to ``EXPRESSION_PATTERNS`` entries the dictionary becomes a constant and the scan
  a narrow projection: no join, no shuffle, text never moves;
* larger dictionaries go through ``anchored_hits``, an equi-join on short byte strings,
  whose cost per text does not grow with the number of patterns.

Texts need a key (one column name or several) and a normalized text column.  The key may
be null and may repeat: the second form tells rows apart by key and text together, which is
as far as their hits can differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needlework.functions.hits import (
    EXPRESSION_PATTERNS,
    Pattern,
    any_matched,
    matched,
    occurrence_sum,
    occurrences,
    weight_sum,
)
from needlework.operators.anchored import anchored_hits
from needlework.operators.dictionary import first_ids, merged_weights
from needlework.tables import kept

CHUNK = 4096
#: Starts that are added up one by one; longer lists are added up block by block.
BLOCK = 64
#: Digest of a text, kept beside the caller's key.
TEXT_ID = "_text_id"
#: Equal rows that come out of one array.
COPIES = 10_000

Keys = str | list[str]


def small_patterns(dictionary: DataFrame, limit: int = EXPRESSION_PATTERNS) -> list[Pattern] | None:
    """The dictionary as a list, or None if it has more than ``limit`` entries.

    At most ``limit + 1`` rows ever reach the driver.
    """
    rows = dictionary.select("pid", "pattern", "weight").where(F.col("pattern") != "").limit(limit + 1).collect()
    return None if len(rows) > limit else [Pattern(*row) for row in sorted(rows)]


def _key_list(key: Keys) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def score_distinct(texts: DataFrame, dictionary: DataFrame, key: Keys = "qid", text: str = "normalized") -> DataFrame:
    """Sum of the weights of the patterns that occur at all."""
    keys, patterns = _key_list(key), small_patterns(dictionary)
    if patterns is not None:
        return texts.select(*keys, once(score=distinct_score(F.col(text), patterns)))
    return _per_row(_sums(texts, merged_weights(dictionary), keys, text, score=F.col("weight")), keys)


def score_occurrences(
    texts: DataFrame, dictionary: DataFrame, key: Keys = "qid", text: str = "normalized"
) -> DataFrame:
    """Sum of weight x start positions; overlapping occurrences all count."""
    keys, patterns = _key_list(key), small_patterns(dictionary)
    if patterns is not None:
        return texts.select(*keys, once(score=occurrence_score(F.col(text), patterns)))
    sums = _sums(texts, merged_weights(dictionary), keys, text, score=F.col("weight") * F.col("hits"))
    return _per_row(sums, keys)


def score_occurrences_first_id(
    texts: DataFrame, dictionary: DataFrame, key: Keys = "qid", text: str = "normalized"
) -> DataFrame:
    """As ``score_occurrences``, but a text filed under several ids counts once."""
    return score_occurrences(texts, first_ids(dictionary), key, text)


def distinct_score(text: Column, patterns: list[Pattern]) -> Column:
    return weight_sum(matched(text, patterns))


def occurrence_score(text: Column, patterns: list[Pattern]) -> Column:
    return occurrence_sum(matched(text, patterns), text)


def once(**columns: Column) -> Column:
    """Costly columns as a generator, so that later filters do not repeat the scan.

    Catalyst pushes a filter on a computed column below the projection and evaluates
    the expression there a second time; it does not move a filter below a generator.
    """
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def _identified(texts: DataFrame, text: str) -> DataFrame:
    return texts.withColumn(TEXT_ID, F.md5(F.col(text)))


def _sums(texts: DataFrame, dictionary: DataFrame, keys: list[str], text: str, **values: Column) -> DataFrame:
    """Keys, digest, number of equal rows and the sums of ``values`` over a row's hits.

    Zero rows are added before the sum, so keys meet their hits in one shuffle and
    texts never leave the scan.  Equal rows all bring the same hits, so the sum of a group
    is a multiple of each row's.
    """
    marked, ids = _identified(texts, text), [*keys, TEXT_ID]
    hits = anchored_hits(marked, dictionary, ids, text)
    rows = marked.select(*ids, F.lit(1).alias("_copies"), *[F.lit(0).cast("bigint").alias(n) for n in values])
    found = hits.select(*ids, F.lit(0).alias("_copies"), *[v.cast("bigint").alias(n) for n, v in values.items()])
    sums = rows.unionByName(found).groupBy(*ids).agg(*[F.sum(n).alias(n) for n in ("_copies", *values)])
    return sums.select(*ids, "_copies", *[F.expr(f"`{n}` div _copies").alias(n) for n in values])


def _per_row(sums: DataFrame, keys: list[str]) -> DataFrame:
    """One row again for each of several equal ones."""
    blocks = F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1, F.lit(COPIES).cast("bigint"))
    cut = sums.select(*keys, "score", "_copies", F.explode(blocks).alias("_first"))
    times = F.least(F.col("_copies") - F.col("_first"), F.lit(COPIES)).cast("int")
    return cut.select(*keys, F.explode(F.array_repeat("score", times)).alias("score"))


def _brought_back(texts: DataFrame, found: DataFrame, ids: list[str], how: str) -> DataFrame:
    """Joins results to the texts they belong to; a null key is a key like any other."""
    names = [f"_found_{i}" for i in range(len(ids))]
    renamed = found.withColumnsRenamed(dict(zip(ids, names, strict=True)))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(ids, names, strict=True)]
    return texts.join(renamed, same, how).drop(*names)


def with_scores(
    texts: DataFrame, dictionary: DataFrame, values: dict[str, Column], key: Keys = "qid", text: str = "normalized"
) -> DataFrame:
    """The texts (all columns) with the sums of ``values``, columns over weight and hits.

    The form for dictionaries of any size; several values cost one scan.
    """
    keys = _key_list(key)
    sums = _sums(texts, dictionary, keys, text, **values).drop("_copies")
    return _brought_back(_identified(texts, text), sums, [*keys, TEXT_ID], "inner").drop(TEXT_ID)


def pattern_hits(texts: DataFrame, dictionary: DataFrame, key: Keys = "qid", text: str = "normalized") -> DataFrame:
    """(key, pid, pattern, weight, hits), one row per text and pattern found in it."""
    keys, patterns = _key_list(key), small_patterns(dictionary)
    if patterns is None:
        return anchored_hits(texts, dictionary, keys, text)
    found = texts.select(*keys, text, F.explode(matched(F.col(text), patterns)).alias("p"))
    count = occurrences(F.col(text), F.col("p.pattern"), F.col("p.overlap"))
    return found.select(*keys, "p.pid", "p.pattern", "p.weight", count.alias("hits"))


def matched_patterns(
    texts: DataFrame, dictionary: DataFrame, key: Keys = "qid", text: str = "normalized"
) -> DataFrame:
    """(key, score, matched): ``pattern(weight)`` items in dictionary order.

    The list of one text holds each pattern at most once, so its length is bounded by
    the dictionary.
    """
    keys, patterns = _key_list(key), small_patterns(dictionary)
    if patterns is not None:
        found = texts.select(*keys, matched(F.col(text), patterns).alias("found"))
    else:
        marked, ids = _identified(texts, text), [*keys, TEXT_ID]
        hits = anchored_hits(marked, dictionary, ids, text)
        lists = hits.groupBy(*ids).agg(F.collect_set(F.struct("pid", "pattern", "weight")).alias("found"))
        found = _brought_back(marked.select(*ids), lists, ids, "left").withColumn("found", F.coalesce("found", F.array()))
    return found.select(*keys, weight_sum(F.col("found")).alias("score"), pattern_list(F.col("found")).alias("matched"))


def pattern_list(found: Column) -> Column:
    items = F.transform(F.array_sort(found), lambda p: F.format_string("%s(%d)", p["pattern"], p["weight"]))
    return F.array_join(items, ", ")


def match_positions(
    texts: DataFrame, dictionary: DataFrame, key: Keys = "qid", text: str = "normalized"
) -> DataFrame:
    """(key, pid, start_pos, end_pos) of every occurrence, 1-based, both ends inclusive.

    Texts are cut into chunks that overlap by the longest pattern, so the work per
    chunk is bounded however long a text is.  An occurrence belongs to the chunk it
    starts in.
    """
    keys, patterns = _key_list(key), small_patterns(dictionary)
    if patterns is None:
        longest = dictionary.agg(F.max(F.char_length("pattern"))).first()[0] or 1
        chunks = _chunks(texts, longest, text, keys)
        found = anchored_hits(chunks, dictionary, [*keys, "chunk", "base"], "chunk")
    else:
        longest = max((len(p.pattern) for p in patterns), default=1)
        chunks = _chunks(texts, longest, text, keys)
        found = chunks.select(
            *keys, "chunk", "base", F.explode(matched(F.col("chunk"), patterns)).alias("p")
        ).select(*keys, "chunk", "base", "p.pid", "p.pattern")
    starts = found.select(
        *keys, "pid", "base", F.char_length("pattern").alias("size"), F.explode(_starts("chunk", "pattern")).alias("at")
    ).where(F.col("at") < CHUNK)
    first = F.col("base") + F.col("at") + 1
    return starts.select(*keys, "pid", first.alias("start_pos"), (first + F.col("size") - 1).alias("end_pos"))


def _chunks(df: DataFrame, longest: int, text: str, columns: list[str]) -> DataFrame:
    """(columns, chunk, base): pieces of CHUNK characters plus ``longest - 1`` more."""
    piece = f"(?s)(?=(.{{1,{CHUNK + longest - 1}}})).{{1,{CHUNK}}}"
    pieces = F.regexp_extract_all(F.col(text), F.lit(piece), F.lit(1))
    exploded = df.select(*columns, F.posexplode(pieces).alias("nr", "chunk"))
    return exploded.select(*columns, "chunk", (F.col("nr").cast("bigint") * CHUNK).alias("base"))


def _starts(chunk: str, pattern: str) -> Column:
    """0-based start offsets of all occurrences, overlapping ones included.

    The chunk is split in front of every occurrence; the offsets are the running sum
    of the piece lengths, taken block by block, because a list is copied whenever it
    grows.  The first piece counts only if an occurrence opens it.
    """
    quoted = F.replace(F.col(pattern), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    before = F.concat(F.lit("(?=\\Q"), quoted, F.lit("\\E)"))
    lengths = F.transform(F.split(F.col(chunk), before, -1), lambda piece: F.char_length(piece))
    firsts = F.sequence(F.lit(1), F.size(lengths), F.lit(BLOCK))
    blocks = F.transform(firsts, lambda first: _running_sum(F.slice(lengths, first, F.lit(BLOCK)), lambda size: size))
    bases = _running_sum(blocks, lambda block: block["at"])["starts"]
    offsets = F.flatten(
        F.zip_with(blocks, bases, lambda block, base: F.transform(block["starts"], lambda at: at + base))
    )
    opens = F.startswith(F.col(chunk), F.col(pattern))
    return F.filter(offsets, lambda at: (at > 0) | opens)


def _running_sum(values: Column, size) -> Column:
    """struct(at, starts): the sum of all sizes, and the sums before each of them."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(
        values,
        empty,
        lambda acc, value: F.struct(
            (acc["at"] + size(value)).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")
        ),
    )


def _flagged(texts: DataFrame, text: str, patterns: list[Pattern]) -> DataFrame:
    return texts.select("*", once(_hit=F.coalesce(any_matched(F.col(text), patterns), F.lit(False))))


def detect_any(texts: DataFrame, dictionary: DataFrame, key: Keys = "qid", text: str = "normalized") -> DataFrame:
    """The texts (all columns) that contain at least one pattern."""
    patterns = small_patterns(dictionary)
    if patterns is not None:
        return _flagged(texts, text, patterns).where(F.col("_hit")).drop("_hit")
    return _by_hits(texts, dictionary, _key_list(key), text, "left_semi")


def detect_none(texts: DataFrame, dictionary: DataFrame, key: Keys = "qid", text: str = "normalized") -> DataFrame:
    """The texts (all columns) that contain no pattern at all."""
    patterns = small_patterns(dictionary)
    if patterns is not None:
        return _flagged(texts, text, patterns).where(~F.col("_hit")).drop("_hit")
    return _by_hits(texts, dictionary, _key_list(key), text, "left_anti")


def _by_hits(texts: DataFrame, dictionary: DataFrame, keys: list[str], text: str, how: str) -> DataFrame:
    marked, ids = _identified(texts, text), [*keys, TEXT_ID]
    hits = anchored_hits(marked, dictionary, ids, text).select(*ids)
    return _brought_back(marked, hits, ids, how).drop(TEXT_ID)


def implications(dictionary: DataFrame) -> DataFrame:
    """(pid, implied_pid): a match of one pattern is always a match of the other.

    Runs over distinct texts (lowest pid each), so copies of one text do not pair up.
    """
    entries = first_ids(dictionary)
    texts = entries.select(F.col("pid").alias("outer_pid"), F.col("pattern").alias("outer_pattern"))
    hits = pattern_hits(texts, entries, "outer_pid", "outer_pattern")
    return hits.where(F.col("pid") != F.col("outer_pid")).select(
        F.col("outer_pid").alias("pid"), F.col("pid").alias("implied_pid")
    )


def implication_steps(implied: DataFrame) -> DataFrame:
    """(pid, implied_pid, steps): the longest chain of implications from one pattern to the other.

    ``implied`` holds all implications, so a chain exists wherever a pair does.  Chains
    are joined end to end, which doubles their length; after as many rounds as the
    logarithm of the longest one nothing changes any more.  Each round is written and read again.
    """
    steps = kept(implied.select("pid", "implied_pid", F.lit(1).cast("bigint").alias("steps")), "steps")
    before = None
    while (now := steps.agg(F.count("*"), F.sum("steps")).first()) != before:
        before = now
        first = steps.select("pid", F.col("implied_pid").alias("middle"), F.col("steps").alias("first"))
        then = steps.select(F.col("pid").alias("middle"), "implied_pid", "steps")
        longer = first.join(then, "middle").select("pid", "implied_pid", (F.col("first") + F.col("steps")).alias("steps"))
        steps = kept(steps.unionByName(longer).groupBy("pid", "implied_pid").agg(F.max("steps").alias("steps")), "steps")
    return steps


def direct_implications(dictionary: DataFrame) -> DataFrame:
    """(pid, implied_pid): the implications that no third pattern lies between."""
    return implication_steps(implications(dictionary)).where("steps = 1").select("pid", "implied_pid")


def implication_order(dictionary: DataFrame) -> DataFrame:
    """(pid, depth, n_direct, n_implied, is_root) of every distinct pattern (lowest pid each).

    depth is the longest chain of implications below a pattern; a root is implied by none.
    """
    steps = implication_steps(implications(dictionary))
    below = steps.groupBy("pid").agg(
        F.max("steps").alias("depth"), F.count_if(F.col("steps") == 1).alias("n_direct"), F.count("*").alias("n_implied")
    )
    above = steps.select(F.col("implied_pid").alias("pid")).distinct().withColumn("implied", F.lit(True))
    entries = first_ids(dictionary).where(F.col("pattern") != "").select("pid")
    zero = F.lit(0).cast("bigint")
    counts = [F.coalesce(c, zero).alias(c) for c in ("depth", "n_direct", "n_implied")]
    return entries.join(below, "pid", "left").join(above, "pid", "left").select("pid", *counts, F.col("implied").isNull().alias("is_root"))
