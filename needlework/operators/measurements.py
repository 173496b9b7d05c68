"""Analytics over tables of timings.

A timing row is (nr, algorithm, dataset_size, pattern_count, time_us, risk); nr is
its position in the source and decides ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needlework import fixed

Axis = tuple[float, float, int]


def throughput(timings: DataFrame) -> DataFrame:
    """Adds queries per second."""
    return timings.withColumn("queries_per_second", F.col("dataset_size") / F.nullif(F.col("time_us") / F.lit(1e6), F.lit(0.0)))


def by_algorithm(timings: DataFrame, algorithms: Sequence[str]) -> DataFrame:
    """First time of each algorithm side by side, and the ratio of the first two."""
    first = F.min_by("time_us", F.col("nr"))
    cells = timings.groupBy("risk", "dataset_size").pivot("algorithm", list(algorithms)).agg(first)
    a, b = algorithms[:2]
    return cells.withColumn("ratio", F.col(f"`{a}`") / F.nullif(F.col(f"`{b}`"), F.lit(0.0)))


def _axis(axis: Axis, nr: Column) -> Column:
    """Point ``nr`` of evenly spaced points, both ends included."""
    start, stop, points = axis
    step = (stop - start) / (points - 1)
    return F.lit(start) + nr * F.lit(step)


def parameter_grid(
    rows: DataFrame, patterns: Axis = fixed.GRID_PATTERNS, sizes: Axis = fixed.GRID_SIZES
) -> DataFrame:
    """Every row once per grid point: adds p, s (indices), pattern_count and dataset_size."""
    indexed = rows.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(patterns[2] - 1)))).withColumn(
        "s", F.explode(F.sequence(F.lit(0), F.lit(sizes[2] - 1)))
    )
    return indexed.withColumn("pattern_count", _axis(patterns, F.col("p"))).withColumn(
        "dataset_size", _axis(sizes, F.col("s"))
    )


def nearest_measurement(timings: DataFrame, sizes: Axis = fixed.GRID_SIZES) -> DataFrame:
    """(algorithm, s, dataset_size, nr, base_us): the timing closest in size per grid size.

    Equal distances go to the row that comes first.  No pairing of timings with grid
    points: each timing falls into one cell between two grid sizes, and per cell only
    its smallest and largest size can be closest to any grid point.  Those two are kept
    by a partial aggregation, after which the data is as small as the grid.
    """
    start, stop, points = sizes
    step = (stop - start) / (points - 1)
    # Cell c holds the sizes from grid point c - 1 up to grid point c.
    cell = F.least(F.greatest(F.floor((F.col("dataset_size") - start) / step) + 1, F.lit(0)), F.lit(points))
    size = F.col("dataset_size").cast("double")
    row = F.struct(size.alias("size"), F.col("nr"), F.col("time_us").alias("base_us"))
    cells = (
        timings.withColumn("cell", cell.cast("int"))
        .groupBy("algorithm", "cell")
        .agg(
            F.min_by(row, F.struct(size, F.col("nr"))).alias("smallest"),
            F.max_by(row, F.struct(size, -F.col("nr"))).alias("largest"),
        )
    )
    grid = cells.select("algorithm").distinct().select(
        "algorithm", F.explode(F.sequence(F.lit(0), F.lit(points))).alias("cell")
    )
    filled = grid.join(cells, ["algorithm", "cell"], "left")
    ordered = Window.partitionBy("algorithm").orderBy("cell")  # points + 1 rows each
    below = F.last("largest", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first("smallest", ignorenulls=True).over(ordered.rowsBetween(1, Window.unboundedFollowing))
    around = filled.select(
        "algorithm",
        F.col("cell").alias("s"),
        _axis(sizes, F.col("cell")).alias("dataset_size"),
        below.alias("below"),
        above.alias("above"),
    ).where(F.col("s") < points)

    def rank(side: str) -> Column:
        return F.struct(F.abs(F.col(f"{side}.size") - F.col("dataset_size")), F.col(f"{side}.nr"))

    nearest = (
        F.when(F.col("above").isNull(), F.col("below"))
        .when(F.col("below").isNull(), F.col("above"))
        .when(rank("below") < rank("above"), F.col("below"))
        .otherwise(F.col("above"))
    )
    return around.select("algorithm", "s", "dataset_size", nearest.alias("nearest")).select(
        "algorithm", "s", "dataset_size", "nearest.nr", "nearest.base_us"
    )


def modelled_time(base_us: Column, pattern_count: Column, dataset_size: Column) -> Column:
    """Time surface: base time plus a share per pattern and the magnitude of the size."""
    by_patterns = (pattern_count - fixed.MODEL_BASE_PATTERNS) * fixed.MODEL_PATTERN_SLOPE
    by_size = F.log10(F.greatest(F.lit(1.0), dataset_size)) * fixed.MODEL_SIZE_SLOPE
    return F.greatest(F.lit(fixed.MODEL_FLOOR), base_us + by_patterns + by_size)


def time_surface(
    timings: DataFrame, patterns: Axis = fixed.GRID_PATTERNS, sizes: Axis = fixed.GRID_SIZES
) -> DataFrame:
    """(algorithm, p, s, pattern_count, dataset_size, time_us) over the whole grid."""
    nearest = nearest_measurement(timings, sizes)
    points = nearest.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(patterns[2] - 1))))
    points = points.withColumn("pattern_count", _axis(patterns, F.col("p")))
    time = modelled_time(F.col("base_us"), F.col("pattern_count"), F.col("dataset_size"))
    return points.select("algorithm", "p", "s", "pattern_count", "dataset_size", time.alias("time_us"))
