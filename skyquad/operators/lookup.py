"""Index lookup for search runs: cells, nearest density pass, subcells in range, slices, distance.

The ratio test doesn't depend on the run, so it comes first (``bandjoin.candidates``); what is left
meets the runs through cell and pass, an equi-join, and is then cut by distance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.base import Value, col
from ..functions.ratios import NAMES
from ..functions.sphere import angular_distance, project_to_view
from .cells import runs_to_cells

QUAD_KEY = [*NAMES, "largest"]
_ORDER = ["offset_pos", "cell_id", "pass", "subcell", "pos"]


def pass_ladders(passes: DataFrame) -> DataFrame:
    """One row per cell: its passes by density, as an array (some ten entries)."""
    step = F.struct("density_rank", "density", "pass", "avg_subcell_radius")
    return passes.groupBy("cell_id").agg(F.array_sort(F.collect_list(step)).alias("ladder"))


def runs_to_passes(runs: DataFrame, passes: DataFrame) -> DataFrame:
    """The passes that each run reads in each cell. ``runs``: image_id, run_id, ra, dec, radius,
    per_degree (wanted quads per square degree), offsets. The pass nearest in density is taken, the
    sparser one of equals, and moved by each offset; offsets that lead out of the ladder read nothing."""
    cells = runs_to_cells(runs, ["image_id", "run_id", "ra", "dec", "radius", "per_degree", "offsets"])
    laddered = cells.join(F.broadcast(pass_ladders(passes)), "cell_id")  # at most 406 rows
    nearest = F.array_min(F.transform("ladder", lambda s: F.struct(F.abs(s["density"] - F.col("per_degree")), s["density_rank"].alias("at"))))["at"]
    chosen = laddered.withColumn("_at", nearest).select("*", F.posexplode("offsets").alias("offset_pos", "offset"))
    chosen = chosen.withColumn("_rank", F.col("_at") + F.col("offset")).filter(F.col("_rank").between(1, F.size("ladder")))
    step = F.element_at("ladder", F.col("_rank").cast("int"))
    return chosen.select(
        "image_id", "run_id", "ra", "dec", "radius", "cell_id", "offset_pos",
        step["pass"].alias("pass"), step["avg_subcell_radius"].alias("avg_subcell_radius"),
    )


def subcell_in_range() -> Column:
    reach = F.col("radius") + F.col("avg_subcell_radius")
    near = F.abs(F.col("center_dec") - F.col("dec")) < reach
    return near & (angular_distance(F.col("center_ra").cast("double"), F.col("center_dec").cast("double"), "ra", "dec") < reach)


def slice_number(pos: Value, n: Value, slices: int) -> Column:
    """The contiguous share of a subcell's ``n`` quads that position ``pos`` is in; the last one takes the rest."""
    size = F.floor(col(n) / slices)
    last = F.lit(slices - 1).cast("long")
    return F.when(size == 0, last).otherwise(F.least(last, F.floor(col(pos) / F.greatest(size, F.lit(1))))).cast("int")


def in_slice(pos: Value, n: Value, slices: int, slice_: int) -> Column:
    """Whether a position is in that share."""
    return F.lit(True) if slices <= 1 else slice_number(pos, n, slices) == slice_


def quads_in_area(quads: DataFrame, subcells: DataFrame, run_passes: DataFrame, slices: int = 1, slice_: int = 0) -> DataFrame:
    """Rows of ``quads`` (catalog quads, or candidates with their image_id) in each run's area. Runs
    become the few subcells in their range first, so that a quad meets the runs of its subcell alone."""
    known = subcells.select("cell_id", "pass", "subcell", "center_ra", "center_dec", "n_quads")
    near = run_passes.join(known, ["cell_id", "pass"]).filter(subcell_in_range())
    keys = ["cell_id", "pass", "subcell"] + (["image_id"] if "image_id" in quads.columns else [])
    found = quads.join(near, keys).filter(in_slice("pos", "n_quads", slices, slice_))
    close = angular_distance(F.col("mid_ra").cast("double"), F.col("mid_dec").cast("double"), "ra", "dec") < F.col("radius")
    return found.filter(close).drop("center_ra", "center_dec", "n_quads", "avg_subcell_radius")


def potential_matches(found: DataFrame) -> DataFrame:
    """Pairs of image quads and *distinct* catalog quads per run, with n_potential, the run's
    number of distinct catalog quads. Catalog quads of equal ratios and size count as one, the
    first by offset, cell, pass, subcell and position."""
    dealt = found.repartition("image_id", "run_id")  # serves both windows and the matching after them
    same = Window.partitionBy("image_id", "run_id", *QUAD_KEY)
    first = dealt.withColumns({
        "_hit": F.max(F.col("is_within").cast("int")).over(same),
        "_rank": F.rank().over(same.orderBy(*_ORDER)),
        "_once": F.row_number().over(same.orderBy(*_ORDER, "quad_id")),
    }).filter("_hit = 1 and _rank = 1")
    count = F.sum((F.col("_once") == 1).cast("long")).over(Window.partitionBy("image_id", "run_id"))
    return first.withColumn("n_potential", count).drop("_hit", "_rank", "_once")


def area_scan(quads: DataFrame, subcells: DataFrame, run_passes: DataFrame) -> DataFrame:
    """Distinct quads of each run's area without regard to any picture."""
    found = quads_in_area(quads, subcells, run_passes)
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("image_id", "run_id", *QUAD_KEY).orderBy(*_ORDER))).filter("_n = 1").drop("_n")


@dataclass(frozen=True)
class View:
    """A simulated camera: its chip, optics and rotation."""

    width: int = 1600
    height: int = 1200
    pixel_microns: float = 3.8
    binning: int = 1
    focal_mm: float = 135.0
    rotation: float = 0.0


def quads_in_view(quads: DataFrame, subcells: DataFrame, run_passes: DataFrame, view: View) -> DataFrame:
    """The quads of each run's area as a camera that points at the run's center sees their middles: x and y,
    and only those inside the frame, its edges included."""
    lits = [F.lit(v) for v in (view.rotation, view.width, view.height, view.pixel_microns, view.binning, view.focal_mm)]
    x, y = project_to_view(F.col("mid_ra").cast("double"), F.col("mid_dec").cast("double"), F.col("ra"), F.col("dec"), *lits)
    seen = area_scan(quads, subcells, run_passes).withColumns({"x": x, "y": y})
    return seen.filter(F.col("x").between(0, view.width) & F.col("y").between(0, view.height))
