"""Whole solves. Their steps have SQL of their own; greedy matching has none, so solutions are held
against the planted plate: every star of the picture is read off it through the solution, and in SQL
through the plate that was planted, and its distance from its place in the catalog compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import pictures, with_sql
from ..functions.plate import pixel_positions
from ..functions.sphere import angular_distance
from ..operators import match
from ..plans import runs, solve
from ..plans import search as searches
from .base import Registry, dist, fixture
from .catalog import fixture_index
from .matching import my_runs, runs_of_the_picture, search

REGISTRY = Registry()
A = REGISTRY.add
NEARBY = runs.NearbyOptions(17.6, 0.9, 5.7, 0.0, 10.0)
_SHOWN = ["image_id", "run_id", "ra", "dec", "radius", "pix_scale", "orientation", "parity", "n_matches", "n_potential"]


def nearby_solution(spark, sf_dir):
    stars = fixture(spark, sf_dir, "image_stars")
    return solve.solve_first(stars, pictures(spark), fixture_index(spark, sf_dir), runs.nearby_runs(spark, NEARBY))


#: The planted plate is centred at (18.0, 0.5), 1e4 pixels to a radian, RA to the left and Dec down the rows.
_PLANTED = with_sql("image_stars", "sky_stars") + f""", off AS (SELECT i.image_id, i.star_id, s.ra, s.dec, -(8e2 - i.x)/1e4 AS px, (6e2 - i.y)/1e4 AS py FROM image_stars i JOIN sky_stars s ON s.star_id = i.star_id),
    sky AS (SELECT *, degrees(radians(18e0) + atan2(-px, cos(radians(5e-1)) - py*sin(radians(5e-1)))) AS p_ra, degrees(asin((sin(radians(5e-1)) + py*cos(radians(5e-1)))/sqrt(1e0 + px*px + py*py))) AS p_dec FROM off)
    SELECT image_id, star_id, floor({dist("ra", "dec", "p_ra", "p_dec")}*1e2)/1e2 AS off FROM sky"""


def stars_through(spark, sf_dir, solved):
    """How far each star, read off the picture, is from its place in the catalog, in steps of a hundredth of a degree."""
    stars, catalog = fixture(spark, sf_dir, "image_stars"), fixture(spark, sf_dir, "sky_stars")
    ra, dec = pixel_positions("x", "y")
    read = stars.join(solved.select("image_id", *"abcdef", "ra0", "dec0"), "image_id").select("image_id", "star_id", ra.alias("p_ra"), dec.alias("p_dec"))
    off = angular_distance("ra", "dec", "p_ra", "p_dec")
    return read.join(catalog, "star_id").select("image_id", "star_id", (F.floor(off * 1e2) / 1e2).alias("off"))


@A("sol_13_solve_star_list", _PLANTED)
def sol_13(spark, sf_dir):
    return stars_through(spark, sf_dir, nearby_solution(spark, sf_dir))


@A("sol_09_try_runs")
def sol_09(spark, sf_dir):
    return solve.solve_runs(search(spark, sf_dir), my_runs(spark)).select(*_SHOWN)


@A("sol_07_solution")
def sol_07(spark, sf_dir):
    return nearby_solution(spark, sf_dir).select(*solve.SOLUTION)


@A("sol_08_refined_centers")
def sol_08(spark, sf_dir):
    found = solve.solve_runs(search(spark, sf_dir), my_runs(spark))
    return found.select("run_id", "ra", "dec", "crval1", "crval2", "n_matches")


@A("join_03_one_to_one_matches")
def join_03(spark, sf_dir):
    s = search(spark, sf_dir)
    return match.one_to_one(solve.find_potential(s, solve.prepare_runs(s, runs_of_the_picture(spark)))).select("run_id", "quad_id", "cell_id", "pass", "subcell", "pos", F.round("scale_ratio", 3).alias("scale_ratio"))


@A("sol_06_find_matches")
def sol_06(spark, sf_dir):
    s = search(spark, sf_dir)
    asked = solve.prepare_runs(s, runs_of_the_picture(spark))
    taken = match.one_to_one(solve.find_potential(s, asked)).join(asked.select("image_id", "run_id", "gate"), ["image_id", "run_id"])
    return match.weighted_bins(match.scale_gate(taken, F.col("gate"))).select("run_id", "quad_id", F.round("scale_ratio", 3).alias("scale_ratio"))


def staged(spark, sf_dir, parallel):
    stars = fixture(spark, sf_dir, "image_stars")
    batches = searches.batch_size if parallel > 1 else searches.serial_batch_size
    return searches.search_staged(stars, pictures(spark), fixture_index(spark, sf_dir), runs.nearby_runs(spark, NEARBY), solve.SolveOptions(sampling=2), parallel, batches=batches)


@A("sol_11_staged_search", _PLANTED)
def sol_11(spark, sf_dir):
    """Subsets, radius groups and batches with early exit, one stage after the other."""
    return stars_through(spark, sf_dir, staged(spark, sf_dir, 1).solved)


@A("sol_10_parallel_search", _PLANTED)
def sol_10(spark, sf_dir):
    """Stages at once; the first success in the order of the plan."""
    return stars_through(spark, sf_dir, staged(spark, sf_dir, 4).solved)


@A("top_07_first_success", _PLANTED)
def top_07(spark, sf_dir):
    """Of all runs that find the picture, that of the first one."""
    return stars_through(spark, sf_dir, solve.first_success(solve.solve_runs(search(spark, sf_dir), my_runs(spark))))
