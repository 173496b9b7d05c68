"""Exactly so many rows of each class, the same ones however the rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy parameter of the sketch: larger ones narrow the band that is counted and ranked.
SKETCH_K = 400
#: Quantiles that are read from a sketch, and how many of them a band reaches up and down at first.
STEPS, REACH = 256, 2


def order_of(key: str) -> Column:
    """A number that depends on the key only, below 2**60."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 15), 16, 10).cast("bigint")


def exact_sample(rows: DataFrame, by: str, n: int, key: str) -> DataFrame:
    """The ``n`` rows of every class ``by`` whose keys hash lowest, all rows of a smaller class.

    A sketch of each class's hashes gives a band that holds the threshold; rows below the
    band are taken as they are, and only rows of the band are ranked, by hash, key and
    the row's other columns.  The counts below the band are exact, and where they show
    that the band missed the threshold it is widened.  No row is sorted but the band's,
    and per class four numbers come to the driver.  Rows without a class or key belong
    to none.
    """
    if n <= 0:
        return rows.limit(0)
    placed = rows.where(F.col(by).isNotNull() & F.col(key).isNotNull()).withColumn("_order", order_of(key))
    sketch = F.kll_sketch_agg_bigint("_order", F.lit(SKETCH_K)).alias("sketch")
    sketched = placed.groupBy(by).agg(F.count("*").alias("rows"), sketch).cache()
    grid = F.array(*[F.lit(k / STEPS) for k in range(STEPS + 1)])
    quantiles, reach = F.kll_sketch_get_quantile_bigint("sketch", grid), REACH
    try:
        while True:
            step = F.floor(F.lit(float(STEPS)) * n / F.col("rows"))
            low = F.when(step < reach, F.lit(-1)).otherwise(F.get(quantiles, F.least(step - reach, F.lit(STEPS)).cast("int")))
            high = F.when(step + reach >= STEPS, F.lit(1 << 60)).otherwise(F.get(quantiles, (step + reach + 1).cast("int")))
            bands = sketched.select(by, "rows", low.alias("low"), high.alias("high")).collect()  # a row per class
            low, high = (_per_class(by, {r[by]: r[c] for r in bands}) for c in ("low", "high"))
            counts = placed.groupBy(by).agg(
                F.count_if(F.col("_order") < low).alias("below"), F.count_if(F.col("_order") <= high).alias("upto")
            )
            found = {r[by]: (r["below"], r["upto"]) for r in counts.collect()}
            if all(below <= n and (upto >= n or upto == r["rows"]) for r in bands for below, upto in [found[r[by]]]):
                break
            reach = 4 * reach + 1
    finally:
        sketched.unpersist()
    missing = n - _per_class(by, {c: below for c, (below, _) in found.items()})
    others = F.xxhash64(*rows.columns)
    ranked = Window.partitionBy(by).orderBy("_order", F.col(key), others)
    band = placed.where((F.col("_order") >= low) & (F.col("_order") <= high))
    cut = band.withColumn("_nr", F.row_number().over(ranked)).where(F.col("_nr") <= missing).drop("_nr")
    return placed.where(F.col("_order") < low).unionByName(cut).drop("_order")


def _per_class(by: str, values: dict) -> Column:
    out = F.lit(None).cast("bigint")
    for name, value in values.items():
        out = F.when(F.col(by) == F.lit(name), F.lit(value).cast("bigint")).otherwise(out)
    return out
