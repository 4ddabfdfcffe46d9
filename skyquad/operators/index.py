"""The catalog index: density-layered quads by sky cell, pass and subcell, and its lookup tables.

``quads`` is written partitioned by cell_id and pass and sorted by r0 within its files, so that a
lookup prunes partitions and row groups. ``index_pass`` and ``index_subcell`` describe it; both are
bounded by the sky grid (406 cells, some passes, up to 144 subcells), never by the catalog.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.base import narrow
from ..functions.sphere import angular_distance
from ..storage import stash
from .cells import add_bounds_center, assign_cells, sky_cells, subdivide
from .quads import catalog_quads

STARS_PER_SUBDIVISION = 2000
LARGEST_CELL = 160.0  # square degrees, more than any cell has
LEAST_DIVISIONS, MOST_DIVISIONS = 2, 12


@dataclass(frozen=True)
class IndexOptions:
    stars_per_square_degree: float = 20.0
    pass_factor: float = math.sqrt(2)
    first_pass: int = 0
    last_pass: int = 9

    def densities(self) -> list[tuple[int, float]]:
        return [(p - self.first_pass, self.stars_per_square_degree * self.pass_factor**p) for p in range(self.first_pass, self.last_pass + 1)]


@dataclass
class Index:
    """Any tables of these columns will do as an index."""

    quads: DataFrame
    passes: DataFrame
    subcells: DataFrame


def divisions(stars_in_cell: Column) -> Column:
    return F.floor(F.least(F.greatest(stars_in_cell / float(STARS_PER_SUBDIVISION), F.lit(float(LEAST_DIVISIONS))), F.lit(float(MOST_DIVISIONS)))).cast("int")


def cell_passes(spark: SparkSession, options: IndexOptions) -> DataFrame:
    """A row per cell and pass: its box, area, number of stars to take and divisions."""
    rows = ", ".join(f"({p}, {density!r}D)" for p, density in options.densities())
    passes = spark.sql(f"SELECT * FROM VALUES {rows} AS t(pass, per_degree)")
    cells = add_bounds_center(sky_cells(spark)).withColumn("area", F.col("height_deg") * F.col("width_deg"))
    # 406 cells times some passes: a constant table.
    table = cells.join(F.broadcast(passes), F.lit(True)).withColumn("_stars", F.col("per_degree") * F.col("area"))
    return table.withColumns({"n_stars": F.floor("_stars").cast("long"), "divisions": divisions(F.col("_stars"))}).drop("_stars")


def index_stars(stars: DataFrame) -> DataFrame:
    """Stars as the index keeps them: single-precision coordinates, magnitude in tenths, cell."""
    kept = stars.select("star_id", F.col("ra").cast("float").cast("double").alias("ra"), F.col("dec").cast("float").cast("double").alias("dec"), F.floor(F.col("mag") * 10).cast("int").alias("mag10"))
    return assign_cells(kept)


def _box_number(value: str, low: str, size: Column) -> Column:
    """Lowest box along one axis that holds the value, edges included: computed from the edges
    themselves, as the quotient alone can be off by one there."""
    guess = F.floor((F.col(value) - F.col(low)) / size).cast("int")
    boxes = F.array(guess - 1, guess, guess + 1)
    holds = lambda k: (k >= 0) & (k < F.col("divisions")) & (F.col(low) + k * size <= F.col(value)) & (F.col(value) <= F.col(low) + (k + 1) * size)
    return F.array_min(F.filter(boxes, holds))


def select_pass_stars(stars: DataFrame, options: IndexOptions) -> DataFrame:
    """The brightest stars of each cell for every pass, with rank and subcell. The bound on the
    rank holds for all cells, so Spark cuts each partition's sort before the shuffle."""
    spark = stars.sparkSession
    table = cell_passes(spark, options)
    most = max((density for _, density in options.densities()), default=0) * LARGEST_CELL
    rank = F.row_number().over(Window.partitionBy("cell_id").orderBy("mag10", "star_id"))
    ranked = index_stars(stars).withColumn("rank", rank).filter(F.col("rank") <= math.ceil(most))
    wanted = table.select("cell_id", "pass", "n_stars", "divisions", "ra_left", "ra_right", "dec_bottom", "dec_top")
    chosen = ranked.join(F.broadcast(wanted), "cell_id").filter(F.col("rank") <= F.col("n_stars"))
    wide = (F.col("ra_right") - F.col("ra_left")) / F.col("divisions")
    high = (F.col("dec_top") - F.col("dec_bottom")) / F.col("divisions")
    across, up = _box_number("ra", "ra_left", wide), _box_number("dec", "dec_bottom", high)
    chosen = chosen.withColumn("subcell", up * F.col("divisions") + across).filter("subcell is not null")
    return chosen.select("cell_id", "pass", "subcell", "star_id", "rank", "ra", "dec", "mag10")


def describe_passes(quads: DataFrame, options: IndexOptions) -> DataFrame:
    """cell_id, pass, n_quads, density, density_rank, divisions, avg_subcell_radius of cells with quads."""
    table = cell_passes(quads.sparkSession, options)
    counted = quads.groupBy("cell_id", "pass").agg(F.count(F.lit(1)).alias("n_quads"))
    with_quads = table.join(counted.select("cell_id").distinct(), "cell_id", "left_semi")
    out = with_quads.join(counted, ["cell_id", "pass"], "left").fillna(0, ["n_quads"])
    out = out.withColumn("density", narrow(F.col("n_quads") / F.col("area")))
    d = F.col("divisions")
    step_ra, step_dec = (F.col("ra_right") - F.col("ra_left")) / d, (F.col("dec_top") - F.col("dec_bottom")) / d
    first = F.col("ra_left") + step_ra / 2, F.col("dec_bottom") + step_dec / 2
    last = F.col("ra_right") - step_ra / 2, F.col("dec_top") - step_dec / 2
    radius = angular_distance(*[narrow(v).cast("double") for v in (*first, *last)]) / (d - 1) / 2
    rank = F.row_number().over(Window.partitionBy("cell_id").orderBy("density", "pass"))
    return out.select("cell_id", "pass", "n_quads", "density", rank.cast("int").alias("density_rank"), "divisions", radius.alias("avg_subcell_radius"))


def describe_subcells(quads: DataFrame, options: IndexOptions) -> DataFrame:
    """cell_id, pass, subcell, center_ra, center_dec, n_quads, first_row (quads of the pass before it)."""
    table = cell_passes(quads.sparkSession, options)
    counted = quads.groupBy("cell_id", "pass", "subcell").agg(F.count(F.lit(1)).alias("n_quads"))
    boxes = subdivide(table.select("cell_id", "pass", "divisions", "ra_left", "ra_right", "dec_bottom", "dec_top"), "divisions")
    boxes = boxes.join(counted.select("cell_id").distinct(), "cell_id", "left_semi")
    centers = boxes.select(
        "cell_id", "pass", "subcell", narrow((F.col("ra_left") + F.col("ra_right")) / 2).alias("center_ra"),
        narrow((F.col("dec_bottom") + F.col("dec_top")) / 2).alias("center_dec"),
    )
    out = centers.join(counted, ["cell_id", "pass", "subcell"], "left").fillna(0, ["n_quads"])
    order = Window.partitionBy("cell_id").orderBy("pass", "subcell").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("first_row", F.sum("n_quads").over(order) - F.col("n_quads"))


def data_offsets(subcells: DataFrame, order: str = "subcell", size: str = "n_bytes") -> DataFrame:
    """Adds data_offset: where the data of each subcell begins in its cell's file (cell_id), from the
    lengths before it. A cell has at most some thousand subcells over all passes."""
    before = Window.partitionBy("cell_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return subcells.withColumn("data_offset", F.sum(size).over(before) - F.col(size))


def build_index(stars: DataFrame, options: IndexOptions = IndexOptions()) -> Index:  # noqa: B008
    """The index of all cells as one job. ``stars``: star_id, ra, dec, mag."""
    quads = stash(catalog_quads(select_pass_stars(stars, options)), "quads")
    return Index(quads, stash(describe_passes(quads, options), "passes"), stash(describe_subcells(quads, options), "subcells"))


def write_index(stars: DataFrame, folder: str, options: IndexOptions = IndexOptions(), resume: bool = True) -> Index:  # noqa: B008
    """Build and write the index. With ``resume``, cells that ``folder`` has are not built again;
    a cell counts as done when its part of the cell table is there, which is written last. Every table
    is partitioned by cell, and a cell's part replaces what a build that failed has left of it. The options
    are stored with the index: going on with others is an error, as cells of both kinds would mix.
    Without ``resume`` an index that is there is removed first."""
    spark = stars.sparkSession
    if not resume:
        for name in ("cells", "quads", "passes", "subcells", "options"):
            _remove(spark, f"{folder}/{name}")
    _keep_options(spark, folder, options)
    done = finished_cells(spark, folder) if resume else None
    todo = assign_cells(stars)
    if done is not None:
        todo = todo.join(F.broadcast(done), "cell_id", "left_anti")  # at most 406 rows
    quads = catalog_quads(select_pass_stars(todo.select(*stars.columns), options))
    dealt = quads.repartition("cell_id", "pass").sortWithinPartitions("cell_id", "pass", "r0")
    mode = {"partitionOverwriteMode": "dynamic"}
    dealt.write.mode("overwrite").options(**mode).partitionBy("cell_id", "pass").parquet(f"{folder}/quads")
    written = _table(spark, folder, "quads").join(F.broadcast(todo.select("cell_id").distinct()), "cell_id", "left_semi")
    tables = {"passes": describe_passes(written, options), "subcells": describe_subcells(written, options), "cells": todo.groupBy("cell_id").count()}
    for name, table in tables.items():
        # Lookup tables of some thousand rows: one file for each cell.
        table.repartition("cell_id").write.mode("overwrite").options(**mode).partitionBy("cell_id").parquet(f"{folder}/{name}")
    return read_index(spark, folder)


def _keep_options(spark: SparkSession, folder: str, options: IndexOptions) -> None:
    """Store the options of a new index; of one that is there, they must be the same."""
    mine = json.dumps(asdict(options), sort_keys=True)
    if _exists(spark, f"{folder}/options/_SUCCESS"):
        stored = spark.read.text(f"{folder}/options").first()[0]
        if stored != mine:
            raise ValueError(f"the index in {folder} was begun with other options: {stored}")
    else:
        spark.createDataFrame([(mine,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/options")


def _remove(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _schema(spark: SparkSession, name: str) -> StructType:
    """Of an index table, from its derivation: a folder without any cell has no file to tell it."""
    quads = catalog_quads(select_pass_stars(spark.createDataFrame([], "star_id long, ra double, dec double, mag double"), IndexOptions()))
    return {"quads": lambda q: q, "passes": lambda q: describe_passes(q, IndexOptions()), "subcells": lambda q: describe_subcells(q, IndexOptions())}[name](quads).schema


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_schema(spark, name)).parquet(f"{folder}/{name}")


def finished_cells(spark: SparkSession, folder: str) -> DataFrame | None:
    """cell_id of the cells an earlier build has finished; None without any."""
    if not _exists(spark, f"{folder}/cells"):
        return None
    return spark.read.schema("count long, cell_id string").parquet(f"{folder}/cells").select("cell_id").distinct()


def _exists(spark: SparkSession, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def read_index(spark: SparkSession, *folders: str) -> Index:
    """One index from the tables of one or more folders (passes of different files make one ladder)."""
    if not folders:
        raise ValueError("no index folder given")
    for folder in folders:
        if not _exists(spark, f"{folder}/quads"):
            raise ValueError(f"no index in {folder}")
    tables = {}
    for name in ("quads", "passes", "subcells"):
        parts = [_table(spark, f, name) for f in folders]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        tables[name] = out
    rank = F.row_number().over(Window.partitionBy("cell_id").orderBy("density", "pass"))
    return Index(tables["quads"], tables["passes"].withColumn("density_rank", rank.cast("int")), tables["subcells"])
