"""Search queues as DataFrames: blind, nearby, point, explicit; slicing and option matrices.

Every queue has the columns run_id, ra, dec, radius; run_id is the position in the queue. Row
counts follow from the options alone, so the levels (a few dozen numbers) are planned on the
driver and the rows are generated on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.base import Value, col, narrow
from ..functions.sphere import angular_distance
from ..operators.cells import assign_cells, runs_to_cells


@dataclass(frozen=True)
class BlindOptions:
    start_radius: float = 22.5
    min_radius: float = 22.5 / 32
    south_first: bool = False
    west_first: bool = False

    def __post_init__(self):
        if not 0 < self.start_radius <= 30:
            raise ValueError("start_radius must be over 0 and at most 30 degrees")
        if not 0 < self.min_radius <= self.start_radius:
            raise ValueError("min_radius must be over 0 and at most start_radius")


@dataclass(frozen=True)
class NearbyOptions:
    ra: float
    dec: float
    max_field_radius: float = 2.0
    min_field_radius: float = 0.0
    search_radius: float = 10.0
    steps: int | None = 0

    def __post_init__(self):
        if not -90 <= self.dec <= 90:
            raise ValueError("dec must be between -90 and 90")
        if self.max_field_radius <= 0 or self.search_radius <= 0:
            raise ValueError("radii must be over 0")
        if self.min_field_radius > self.max_field_radius:
            raise ValueError("min_field_radius must not exceed max_field_radius")


def row_positions(rows: DataFrame, circle: float) -> DataFrame:
    """Positions of each row (row_dec, spacing, n): k of them, staggered by half a step in odd rows.
    Steps and positions are single precision."""
    k = (F.ceil(F.cos(F.radians("row_dec")) * circle / (F.col("spacing") * 2e0)) + 1).cast("long")
    rows = rows.withColumn("k", k).withColumn("step", narrow(F.lit(circle) / F.col("k")))
    rows = rows.withColumn("offset", narrow((F.col("n") % 2).cast("float") * narrow(F.lit(0.5)) * F.col("step")))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    at = narrow(F.col("offset") + F.col("i").cast("float") * F.col("step"))
    return rows.withColumn("at", at % F.lit(circle).cast("float"))


def blind_runs(spark: SparkSession, options: BlindOptions = BlindOptions()) -> DataFrame:  # noqa: B008
    """The whole sky in rows of circles, four quadrants a radius, radii halved from level to level."""
    rows, radius, level = [], options.start_radius, 0
    while radius >= options.min_radius:
        dec, n = 0.0, 0
        while True:
            rows += [(level, q, n, min(dec, 90.0), radius) for q in range(4)]
            if dec >= 90:
                break
            dec, n = dec + radius, n + 1
        radius, level = radius / 2, level + 1
    table = spark.createDataFrame(rows, "level int, quadrant int, n int, row_dec double, radius double")
    found = row_positions(table.withColumn("spacing", F.col("radius")), 180.0)
    south = F.col("quadrant") < 2 if options.south_first else F.col("quadrant") >= 2
    west = F.col("quadrant") % 2 == (0 if options.west_first else 1)
    ra = F.col("at")
    found = found.withColumns({
        "ra": F.when(west, narrow(ra + F.lit(180).cast("float"))).otherwise(ra).cast("double"),
        "dec": F.when(south, -F.col("row_dec")).otherwise(F.col("row_dec")) + 0e0,
    })
    return _numbered(found, "level", "quadrant", "n", "i")


def _numbered(found: DataFrame, *order: str) -> DataFrame:
    """run_id in queue order: positions within a row are known, so only row counts are summed."""
    rows = found.groupBy(*order[:-1]).agg(F.count(F.lit(1)).alias("_n"))
    # A table of rows of circles (some hundred), not of circles: one task is enough.
    before = Window.orderBy(*order[:-1]).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = found.join(F.broadcast(starts.drop("_n")), list(order[:-1]))
    return out.select((F.col("_start") + F.col(order[-1])).alias("run_id"), "ra", "dec", "radius")


def radius_ladder(largest: float, least: float = 0.0, steps: int | None = 0) -> list[float]:
    """Radii of a nearby search. ``steps`` None halves until the least is passed; a number takes
    that many equal steps. As in the original, the last one may lie below the least, which follows again."""
    if least <= 0:
        return [largest]
    if least == largest:
        return [largest]
    out, radius = [largest], largest
    if steps == 0:
        return [largest, least]
    while radius > least:
        radius = radius / 2 if steps is None else radius - (largest - least) / (steps + 1)
        out.append(radius)
    return [*out, least]


def nearby_runs(spark: SparkSession, options: NearbyOptions) -> DataFrame:
    """Circles around a position, nearest first, for each radius of the ladder."""
    rows, n, hint = [], 0, (options.ra, options.dec)
    radii = radius_ladder(options.max_field_radius, options.min_field_radius, options.steps)
    for level, radius in enumerate(radii):
        dec, top = max(options.dec - options.search_radius, -90.0), min(options.dec + options.search_radius, 90.0)
        while dec <= top:
            rows.append((level, n, dec, radius, float(np.float32(radius))))
            dec, n = dec + radius, n + 1
    table = spark.createDataFrame(rows, "level int, n int, row_dec double, spacing double, radius double")
    found = row_positions(table, 360.0).select("level", "n", "i", F.col("at").cast("double").alias("ra"), F.col("row_dec").alias("dec"), "radius")
    found = found.withColumn("distance", angular_distance("ra", "dec", F.lit(hint[0]), F.lit(hint[1]))).filter(F.col("distance") < options.search_radius)
    first = [(level, -1, -1, *map(float, hint), float(np.float32(r)), 0.0) for level, r in enumerate(radii)]
    found = found.unionByName(spark.createDataFrame(first, "level int, n int, i long, ra double, dec double, radius double, distance double"))
    # One queue is bounded by (search radius / field radius)^2 circles: it is ordered in one task.
    order = Window.orderBy("level", "distance", "n", "i")
    return found.withColumn("run_id", F.row_number().over(order).cast("long") - 1).select("run_id", "ra", "dec", "radius", "distance")


def point_runs(spark: SparkSession, ra: float, dec: float, radius: float = 2.0) -> DataFrame:
    return spark.createDataFrame([(0, float(ra), float(dec), float(radius))], "run_id long, ra double, dec double, radius double")


def point_runs_of(pictures: DataFrame, radius: float | None = None) -> DataFrame:
    """A plan of one circle for each picture: image_id, ra, dec and, without ``radius``, radius."""
    size = F.col("radius") if radius is None else F.lit(float(radius))
    return pictures.select("image_id", F.lit(0).cast("long").alias("run_id"), F.col("ra").cast("double").alias("ra"), F.col("dec").cast("double").alias("dec"), size.cast("double").alias("radius"))


def first_run_at(runs: DataFrame, places: DataFrame) -> DataFrame:
    """For each place (place_id, ra, dec) the first run that holds it, and how many do. They meet through
    the cells that runs touch and places lie in."""
    near = runs_to_cells(runs, ["run_id", "ra", "dec", "radius"]).drop("band", "cell")
    at = assign_cells(places).select("place_id", F.col("ra").alias("at_ra"), F.col("dec").alias("at_dec"), "cell_id")
    held = at.join(near, "cell_id").filter(angular_distance("ra", "dec", "at_ra", "at_dec") < F.col("radius"))
    return held.groupBy("place_id").agg(F.min("run_id").alias("run_id"), F.count(F.lit(1)).alias("n_runs"))


def sector(ra: Value, slices: int) -> Column:
    """RA sector of a run; the shared edge belongs to the lower one."""
    return F.greatest(F.lit(0).cast("long"), F.ceil(col(ra) / (360e0 / slices)).cast("long") - 1)


def sectors_at(runs: DataFrame, places: DataFrame, slices: int) -> DataFrame:
    """run_id and sector of every run, with place_id and place_sector of each place (place_id, ra, dec) in
    it, if any; a place in no run has a row of its own. They meet as in ``first_run_at``."""
    near = runs_to_cells(runs, ["run_id", "ra", "dec", "radius"]).drop("band", "cell")
    at = assign_cells(places).select("place_id", F.col("ra").alias("at_ra"), F.col("dec").alias("at_dec"), "cell_id", sector("ra", slices).alias("place_sector"))
    inside = (at["cell_id"] == near["cell_id"]) & (angular_distance("ra", "dec", "at_ra", "at_dec") < F.col("radius"))
    held = at.join(near, inside, "left").select("run_id", "place_id", "place_sector")
    return runs.select("run_id", sector("ra", slices).alias("sector")).join(held, "run_id", "full")


def sliced(runs: DataFrame, slices: int, slice_: int) -> DataFrame:
    return runs.filter(sector("ra", slices) == slice_)


def density_offsets(lower: Value | int, higher: Value | int) -> Column:
    lower, higher = (F.lit(v) if isinstance(v, int) else col(v) for v in (lower, higher))
    return F.sequence(-lower, higher)


def explicit_runs(given: DataFrame) -> DataFrame:
    """A queue of runs that are given (run_id, ra, dec, radius), renumbered from 0 in their order.
    Positions are counted by ranges of run_id, so that no task numbers them all."""
    keyed = given.select("ra", "dec", "radius", F.col("run_id").alias("_given"), F.shiftright(F.col("run_id").cast("long"), 16).alias("_range"))
    counts = keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for 65,536 positions
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_given")) - 1
    return keyed.withColumn("_i", inside).join(starts, "_range").select((F.col("_start") + F.col("_i")).alias("run_id"), "ra", "dec", "radius")


def in_batches(runs: DataFrame, size: int) -> DataFrame:
    """Adds batch: runs of a radius are contiguous in the queue, so their numbers tell it."""
    first = runs.groupBy("radius").agg(F.min("run_id").alias("_first"))
    # Distinct radii of a plan: some dozen rows.
    return runs.join(F.broadcast(first), "radius").withColumn("batch", F.floor((F.col("run_id") - F.col("_first")) / size)).drop("_first")


def by_radius(runs: DataFrame) -> DataFrame:
    """radius_group counts distinct radii, the largest first; batch numbers are left to the search."""
    groups = runs.select("radius").distinct()
    # Distinct radii of a plan: some dozen rows.
    ranked = groups.withColumn("radius_group", F.row_number().over(Window.orderBy(F.desc("radius"))))
    return runs.join(F.broadcast(ranked), "radius")


def variations(spark: SparkSession, samplings: list[int], radii: list[tuple[float, float]], offsets: list[tuple[int, int]]) -> DataFrame:
    """Benchmark settings: every sampling with every radius range and every pair of offsets."""
    rows = [(s, float(min(r)), float(max(r)), lo, hi) for s in samplings for r in radii for lo, hi in offsets]
    return spark.createDataFrame(rows, "sampling int, min_radius double, max_radius double, lower_offset int, higher_offset int")


def variations_of(pictures: DataFrame, samplings: list[int], radii: list[tuple[float, float]], offsets: list[tuple[int, int]]) -> DataFrame:
    """``variations`` for every row of ``pictures``."""
    rows = variations(pictures.sparkSession, samplings, radii, offsets).collect()  # of lists that are given
    every = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.asDict().items()]) for r in rows])
    return pictures.withColumn("_setting", F.explode(every)).select(*pictures.columns, "_setting.*")


def ladder_sizes(options: BlindOptions) -> int:
    """Number of runs of a blind queue, without running it."""
    total, radius = 0, options.start_radius
    while radius >= options.min_radius:
        dec = 0.0
        while True:
            total += 4 * (math.ceil(math.cos(math.radians(min(dec, 90.0))) * 180 / (2 * radius)) + 1)
            if dec >= 90:
                break
            dec += radius
        radius /= 2
    return total
