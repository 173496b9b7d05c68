"""Mixing sources to target weights by repeating and thinning whole documents.

Sizes are summed per source, targets are shared out by weight under a cap on repetition,
and each document is emitted ``floor(rate)`` times plus once more with probability
``rate - floor(rate)``, decided by a seeded hash of its id and text; equal rows have
coins of their own.  Of a few seeds each source takes the one whose coins come nearest
to its target, so a coin is fair before the seeds are compared, not after.  Everything
is DataFrame operations: the wide steps are aggregations with partial sums in the map
tasks and one join of rows that are equal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needlework.llm.store import stored

#: Runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys of equal rows that are sent to all tasks; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: A table of at most this many sources is broadcast; a longer one is joined by shuffle.
BROADCAST_SOURCES = 50_000


@dataclass(frozen=True)
class Mix:
    """weights: of the sources in order of their names, repeating; most: largest rate;
    seeds: how many hash seeds are tried per source."""

    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    seeds: int = 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def numbered(sources: DataFrame) -> DataFrame:
    """Adds ``nr``, 0 for the first source by code point, a null name last.

    Rows are ranged by name and numbered inside their ranges; only the ranges' lengths
    meet at the driver.
    """
    order = F.col("source").asc_nulls_last()
    ranged = stored(
        sources.repartitionByRange(order)
        .sortWithinPartitions(order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before, starts = 0, []
    for row in sorted(ranged.groupBy("_range").count().collect()):
        starts += [F.lit(row["_range"]), F.lit(before)]
        before += row["count"]
    start = F.create_map(*starts)[F.col("_range")] if starts else F.lit(0)
    return ranged.withColumn("nr", (start + F.col("_row")).cast("bigint")).drop("_range", "_row")


def targets(sizes: DataFrame, how: Mix) -> DataFrame:
    """source, source_size -> also weight and target.

    A target stops at ``most`` times the source's size; the excess is shared again by
    weight until none is above.  Each round only sums the sources that are capped.
    """
    weight = F.element_at(F.array(*map(F.lit, how.weights)), (F.col("nr") % len(how.weights)).cast("int") + 1)
    table = numbered(sizes).withColumn("weight", weight.cast("bigint"))
    cap = F.col("source_size") * how.most
    everything = table.agg(F.sum("source_size")).first()[0] or 0
    free, capped = None, F.lit(False)
    while True:
        now = table.agg(
            F.sum(F.when(capped, cap).otherwise(0)).alias("used"),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("weights"),
            F.sum(capped.cast("int")).alias("n"),
        ).first()
        if free is not None and now["n"] == free[2]:
            break
        free = (everything - (now["used"] or 0), now["weights"] or 0, now["n"])
        # once above the cap a source stays there, because the common share only grows
        capped = cap.cast("double") * F.lit(float(free[1])) < F.lit(float(free[0])) * F.col("weight")
    share = F.lit(free[0]).cast("double") * F.col("weight") / F.lit(max(free[1], 1)).cast("double")
    return table.withColumn("target", F.when(capped, cap.cast("double")).otherwise(share)).drop("nr")


def chance(coin: Column, seed: Column) -> Column:
    """A number in [0, 1) that depends on the row's coin and the seed only."""
    text = F.concat(coin, F.lit(":"), seed.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_coins(rows: DataFrame) -> DataFrame:
    """Adds ``_mix_coin``: id and hash of the text, and for rows equal in both a number of their own.

    That number is the row's place in its partition, so equal rows are thinned one by one;
    which of them stay may change with the partitions, how many hardly does.
    """
    key = F.xxhash64("doc_id", "text", "source")
    text = F.concat_ws("|", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))
    keyed = rows.withColumn("_mix_key", key)
    again = stored(keyed.groupBy("_mix_key").count().where("count > 1").select("_mix_key"))
    if again.isEmpty():
        return rows.withColumn("_mix_coin", text)
    if again.count() <= BROADCAST_KEYS:
        again = F.broadcast(again)
    own = F.concat_ws("|", text, F.monotonically_increasing_id().cast("string"))
    numbered = keyed.withColumn("_mix_own", own)
    marked = numbered.join(again.withColumn("_mix_again", F.lit(True)), "_mix_key", "left")
    return marked.withColumn("_mix_coin", F.when(F.col("_mix_again"), F.col("_mix_own")).otherwise(text)).drop("_mix_key", "_mix_own", "_mix_again")


def by_source(rows: DataFrame, rates: DataFrame, names: list[str]) -> DataFrame:
    """Each row with its source's ``names``; null is a source like any other.

    The table of sources is broadcast if it is short.  Otherwise the join is a shuffle
    whose large partitions Spark splits, so a source with a third of the rows is no
    single task's work.
    """
    keyed = rates.select(F.col("source").alias("_mix_source"), *[F.col(n).alias(f"_mix_{n}") for n in names])
    if rates.count() <= BROADCAST_SOURCES:
        keyed = F.broadcast(keyed)
    return rows.join(keyed, F.col("source").eqNullSafe(F.col("_mix_source")), "left").drop("_mix_source")


def sized_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and coin of every document; stored."""
    return stored(with_coins(docs.select("doc_id", "source", "text")).select("doc_id", "source", "_mix_coin", n_words(F.col("text")).alias("size")))


def rates(sized: DataFrame, how: Mix = Mix()) -> DataFrame:
    """doc_id, source, size, coin -> per source: source_size, target, rate, seed, as a stored table.

    Every seed gives an honest coin per document.  Of a few the one is taken under which
    the source's words come nearest to its target, which matters for sources of few or
    very unequal documents.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    table = stored(targets(sizes, how).withColumn("rate", rate))
    rows = by_source(sized, table, ["rate"])
    taken = [
        F.sum(copies(F.col("_mix_coin"), F.col("_mix_rate"), F.lit(k)) * F.col("size")).alias(f"_s{k}")
        for k in range(how.seeds)
    ]
    tried = rows.groupBy("source").agg(*taken).withColumnRenamed("source", "_mix_source")
    tried = table.join(tried, F.col("source").eqNullSafe(F.col("_mix_source")), "left")
    misses = F.array(*[F.abs(F.coalesce(F.col(f"_s{k}"), F.lit(0)) - F.col("target")) for k in range(how.seeds)])
    seed = F.array_position(misses, F.array_min(misses)) - 1
    return stored(tried.select("source", "source_size", "weight", "target", "rate", seed.alias("seed")))


def copies(coin: Column, rate: Column, seed: Column) -> Column:
    whole = F.floor(rate)
    return whole + (chance(coin, seed) < rate - whole).cast("bigint")


def mixed(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words, repeats counted).

    A null text has size 0, a null source is a source of its own, sources without words
    take nothing, a null id is an id like any other, repeated rows have coins of their own,
    an empty table gives no rows.  Columns other than doc_id, source and text are ignored.
    """
    sized = sized_rows(docs)
    table = rates(sized, how)
    rows = by_source(sized, table, ["source_size", "target", "rate", "seed"])
    taken = copies(F.col("_mix_coin"), F.col("_mix_rate"), F.col("_mix_seed")) * F.col("size")
    return rows.select(
        "doc_id", "source", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"),
        taken.alias("taken"),
    )


def mix(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with their own columns.

    Nulls, repeated rows and empty tables are as with ``mixed``; the text's words are counted.
    """
    rows = by_source(with_coins(docs), rates(sized_rows(docs), how), ["rate", "seed"])
    times = copies(F.col("_mix_coin"), F.col("_mix_rate"), F.col("_mix_seed")).cast("int")
    copied = rows.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), times)))
    return copied.select(*[F.col(f"`{c}`") for c in docs.columns])
