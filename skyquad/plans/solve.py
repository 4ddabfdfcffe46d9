"""The solver: star lists or pictures, an index and a search plan to plate solutions.

``solve_runs`` evaluates any number of runs of any number of pictures as one job. ``solve_first``
takes all runs at once and keeps each picture's first success. Searches in stages, which stop as soon as
every picture has a solution, are in ``search``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.plate import add_wcs, diagonal, quads_per_square_degree
from ..operators import fit, lookup, match
from ..operators.bandjoin import candidates, ratio_range
from ..operators.cells import runs_to_cells
from ..operators.index import Index
from ..operators.quads import brightest, picture_quads
from ..storage import stash, stash_observed
from .runs import density_offsets

#: Recommended limits; values beyond them are slow or unlikely to solve, not wrong.
LIMITS = {"search_radius": 60.0, "density_offset": 3, "max_stars": 1200, "field_radius": (0.1, 16.0)}
SOLUTION = [
    "image_id", "run_id", "ra", "dec", "radius", "orientation", "pix_scale", "parity", "field_width", "field_height",
    "cd1_1", "cd1_2", "cd2_1", "cd2_2", "cdelt1", "cdelt2", "crota1", "crota2", "crval1", "crval2", "crpix1", "crpix2",
    "a", "b", "c", "d", "e", "f", "ra0", "dec0", "width", "height", "n_matches",
]


@dataclass(frozen=True)
class SolveOptions:
    max_stars: int | None = None
    sampling: int | None = None
    lower_offset: int = 1
    higher_offset: int = 1

    def __post_init__(self):
        if self.max_stars is not None and self.max_stars < 4:
            raise ValueError("max_stars must be at least 4")
        if self.sampling is not None and self.sampling < 1:
            raise ValueError("sampling must be at least 1")
        if self.lower_offset < 0 or self.higher_offset < 0:
            raise ValueError("density offsets must not be negative")

    @property
    def subsets(self) -> int:
        return self.sampling or 4


@dataclass
class Search:
    """Pictures, their quads and the index rows that can match them."""

    pictures: DataFrame  # image_id, width, height
    quads: DataFrame
    pairs: DataFrame
    index: Index
    options: SolveOptions = field(default_factory=SolveOptions)
    n_quads: int = 0
    n_pairs: int = 0


def in_area(index: Index, runs: DataFrame) -> Index:
    """The index of the cells that any of the runs meets. The cells (406 at most) are known before the
    scan, so the other cells' files aren't opened."""
    cells = runs_to_cells(runs, []).select("cell_id").distinct()
    wanted = sorted(r[0] for r in cells.collect())
    return Index(*[t.filter(F.col("cell_id").isin(wanted)) for t in (index.quads, index.passes, index.subcells)])


def open_search(
    stars: DataFrame, pictures: DataFrame, index: Index, options: SolveOptions = SolveOptions(), runs: DataFrame | None = None,  # noqa: B008
) -> Search:
    """``stars``: image_id, star_id, x, y, brightness, size. ``pictures``: image_id, width, height.
    With ``runs`` (ra, dec, radius) only their area of the index is read."""
    index = index if runs is None else in_area(index, runs)
    quads = stash_observed(picture_quads(brightest(stars, options.max_stars)), "picture-quads")
    low, high = ratio_range(quads.table)
    in_range = index.quads.filter(F.col("r0").between(F.lit(low).cast("float"), F.lit(high).cast("float")))
    pairs = stash_observed(candidates(quads.table, in_range), "pairs")
    return Search(pictures, quads.table, pairs.table, index, options, quads.facts["n"], pairs.facts["n"])


def runs_of_pictures(search: Search, runs: DataFrame) -> DataFrame:
    """The runs with the image_id of each picture that has a candidate in a cell they meet: no other
    run can find anything. Runs and pictures meet through those cells, not in a product."""
    cells = runs_to_cells(runs, ["run_id", "image_id"] if "image_id" in runs.columns else ["run_id"]).drop("band", "cell")
    met = search.pairs.select("image_id", "cell_id").distinct().join(cells, [c for c in ("image_id", "cell_id") if c in cells.columns])
    met = met.select("image_id", "run_id").distinct()
    return runs.join(met, [c for c in ("image_id", "run_id") if c in runs.columns])


def prepare_runs(search: Search, runs: DataFrame) -> DataFrame:
    """Adds the picture's size, the wanted quad density, offsets and the scale gate to the runs (with
    image_id) of each picture."""
    counts = search.quads.groupBy("image_id").agg(F.max("n_first").alias("n_first"))
    every = runs.join(search.pictures.join(counts, "image_id"), "image_id")
    offsets = density_offsets(search.options.lower_offset, search.options.higher_offset)
    return every.withColumns({
        "per_degree": quads_per_square_degree("n_first", "radius", "width", "height"),
        "offsets": offsets,
        "gate": diagonal("width", "height") / (F.col("radius") * 2e0) * 0.01,
    })


def find_potential(search: Search, runs: DataFrame, slices: int = 1, slice_: int = 0) -> DataFrame:
    passes = lookup.runs_to_passes(runs, search.index.passes)
    return lookup.potential_matches(lookup.quads_in_area(search.pairs, search.index.subcells, passes, slices, slice_))


def count_potential(potential: DataFrame) -> DataFrame:
    """image_id, run_id, n_potential."""
    return potential.groupBy("image_id", "run_id").agg(F.max("n_potential").alias("n_potential"))


def rank_runs(runs: DataFrame, counted: DataFrame) -> DataFrame:
    """run_id, n_potential, has_matches and place, most potential matches first. ``runs`` is a batch of
    one picture: some thousand rows, which are ranked as a whole."""
    every = runs.join(counted, "run_id", "left").fillna(0, ["n_potential"])
    place = F.row_number().over(Window.orderBy(F.desc("n_potential"), "run_id")).cast("long")
    return every.select("run_id", "n_potential", (F.col("n_potential") > 0).alias("has_matches"), place.alias("place"))


def is_valid() -> Column:
    """No NaN in position or orientation, finite constants."""
    ok = F.lit(True)
    for name in ("ra", "dec", "orientation"):
        ok = ok & F.col(name).isNotNull() & ~F.isnan(name)
    for name in fit.CONSTANTS:
        ok = ok & (F.abs(F.col(name)) < float("inf")) & ~F.isnan(name)
    return ok


def plausible(radius: str = "radius", run_radius: str = "run_radius") -> Column:
    """A solution's radius is at most twice that of its run."""
    return F.col(radius) <= F.col(run_radius) * 2


def fit_matches(potential: DataFrame, runs: DataFrame) -> DataFrame:
    """Plate solutions of the runs. ``runs`` has ra0, dec0 (reference position) and gate besides width and height."""
    taken = match.one_to_one(potential).join(runs.select("image_id", "run_id", "gate", "ra0", "dec0"), ["image_id", "run_id"])
    trusted = match.weighted_bins(match.scale_gate(taken, F.col("gate")))
    kept = stash(fit.clip_influence(fit.with_plane(trusted)), "matches")
    plates = fit.fit_plates(kept).join(fit.pixels_per_degree(kept), ["image_id", "run_id"])
    sized = plates.join(runs.select("image_id", "run_id", "width", "height"), ["image_id", "run_id"])
    # A row per run that got so far. Written before it is filtered: the filter would be pushed below
    # the derivation and repeat it many times over.
    return stash(add_wcs(stash(sized, "plates")).select(*SOLUTION), "solved").filter(is_valid())


def solve_runs(search: Search, runs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Solutions of all runs (columns SOLUTION and n_potential). A first solution of more than
    twice the run's radius is dropped; the others are refined around their own center and radius."""
    asked = prepare_runs(search, runs_of_pictures(search, runs)).withColumns({"ra0": F.col("ra"), "dec0": F.col("dec")})
    if only is not None:
        asked = asked.join(only, ["image_id", "run_id"], "left_semi")
    asked = stash(asked, "runs")
    potential = stash(find_potential(search, asked), "potential")
    first = fit_matches(potential, asked)
    extra = asked.select("image_id", "run_id", "per_degree", "offsets", F.col("radius").alias("run_radius"))
    again = first.select("image_id", "run_id", "ra", "dec", "radius", "width", "height").join(extra, ["image_id", "run_id"])
    again = again.filter(plausible())
    # The gate's factor of two stands outside the quotient, as in the original: it is looser here.
    again = again.withColumns({"ra0": F.col("ra"), "dec0": F.col("dec"), "gate": diagonal("width", "height") / F.col("radius") * 2e0 * 0.01})
    refined = fit_matches(find_potential(search, again), again)
    return refined.join(count_potential(potential), ["image_id", "run_id"])


def first_success(solutions: DataFrame) -> DataFrame:
    """Each picture's solution of the earliest run of the plan."""
    first = solutions.groupBy("image_id").agg(F.min("run_id").alias("run_id"))
    return solutions.join(first, ["image_id", "run_id"], "left_semi")


def solve_first(stars: DataFrame, pictures: DataFrame, index: Index, runs: DataFrame, options: SolveOptions = SolveOptions()) -> DataFrame:  # noqa: B008
    """Bulk mode: all runs of all pictures at once, on whole subcells."""
    return first_success(solve_runs(open_search(stars, pictures, index, options, runs), runs))


def solve_schema() -> str:
    kinds = {"image_id": "long", "run_id": "long", "parity": "string", "n_matches": "long", "width": "long", "height": "long"}
    return ", ".join(f"{c} {kinds.get(c, 'double')}" for c in SOLUTION) + ", n_potential long"


__all__ = ["LIMITS", "Search", "SolveOptions", "open_search", "solve_first", "solve_runs"]
