"""From picture files to plate solutions: reading, star detection, a search plan from the headers.

Pictures whose headers tell position and view are searched around that position; the others, and those
that aren't solved there, by the runs of a fallback plan, if one is given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.base import narrow
from ..functions.sphere import angular_distance
from ..operators.detect import detect_in_pictures
from ..operators.index import Index
from ..sources.fits import decode_pixels, fits_pictures, read_star_lists
from ..sources.raster import jpeg_pictures, png_pictures
from ..sources.registry import own_readers
from ..storage import new_folder, stash, stash_observed
from .runs import row_positions
from .search import Progress
from .solve import SOLUTION, SolveOptions, solve_first

Detector = Callable[[DataFrame, DataFrame], DataFrame]
PICTURE = ["image_id", "path", "width", "height", "bits", "data", "center", "view", "error"]


def image_id(path: Column) -> Column:
    return F.xxhash64(path)


def read_pictures(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row for each FITS, PNG and JPEG file under ``path``, by content: image_id, path, width,
    height, bits, data (samples as ``fits.decode_pixels`` reads them), center and view (from FITS
    headers, else null), and error where a file can't be read. Files of an extension for which a
    reader was registered (``sources.register_reader``) are that reader's: it gets the path and returns
    those of these columns that it knows."""
    files = spark.read.format("binaryFile").load(path)
    own = own_readers()
    extension = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    files = files.filter(~extension.isin(*own)) if own else files
    found = fits_pictures(files).drop("headers", "offset")
    for more in (png_pictures(files), jpeg_pictures(spark, path, files)):
        found = found.unionByName(more, allowMissingColumns=True)
    for reader in dict.fromkeys(own.values()):
        rows = reader(spark, path)
        rows = rows.select(*[c for c in PICTURE if c in rows.columns]).filter(extension.isin(*[e for e, r in own.items() if r is reader]))
        found = found.unionByName(rows.drop("image_id"), allowMissingColumns=True)
    return found.withColumn("image_id", image_id(F.col("path"))).select(*PICTURE)


def put_files(spark: SparkSession, contents: dict[str, bytes]) -> str:
    """A folder of the shared one with contents that are at hand, by name, as from standard input."""
    folder = new_folder(spark, "at-hand")
    for name, content in contents.items():
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
    return folder


def pictures_from_bytes(spark: SparkSession, contents: dict[str, bytes]) -> DataFrame:
    """As ``read_pictures``, of contents that are at hand (by name)."""
    found = read_pictures(spark, put_files(spark, contents))
    name = F.element_at(F.split("path", "/"), -1)
    return found.withColumn("path", name).withColumn("image_id", image_id(F.col("path"))).select(*PICTURE)


def star_lists_from_bytes(spark: SparkSession, contents: dict[str, bytes]) -> DataFrame:
    """image_id, star_id, x, y, brightness, size of star lists that are at hand (by name)."""
    stars = read_star_lists(spark, put_files(spark, contents))
    return stars.withColumn("path", F.element_at(F.split("path", "/"), -1)).withColumn("image_id", image_id(F.col("path"))).drop("path")


def dataset_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path and length of a data set's files, by name pattern; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length")


def circles_around(asked: DataFrame, search_radius: float) -> DataFrame:
    """Rows of circles over the whole sky within ``search_radius`` in Dec of each picture's position:
    ``asked`` (image_id, c_ra, c_dec, radius) with n (the row), i (the circle there), ra, dec and distance."""
    bottom, top = F.greatest(F.col("c_dec") - search_radius, F.lit(-90e0)), F.least(F.col("c_dec") + search_radius, F.lit(90e0))
    rows = asked.withColumns({"spacing": F.col("radius"), "n": F.explode(F.sequence(F.lit(0), F.floor((top - bottom) / F.col("radius")).cast("int")))})
    rows = rows.withColumn("row_dec", bottom + F.col("n") * F.col("radius"))
    around = row_positions(rows, 360.0).select("image_id", "n", "i", F.col("at").cast("double").alias("ra"), F.col("row_dec").alias("dec"), "radius", "c_ra", "c_dec")
    return around.withColumn("distance", angular_distance("ra", "dec", "c_ra", "c_dec"))


def hinted_runs(pictures: DataFrame, search_radius: float = 10.0) -> DataFrame:
    """The nearby plan of every picture that has a center and a view: circles of the view's half
    diagonal, the one at the center first, then by distance. image_id, run_id, ra, dec, radius, distance."""
    half = narrow(F.hypot("view.width_deg", "view.height_deg") / 2).cast("double")
    asked = pictures.filter("center is not null and view is not null").select("image_id", F.col("center.ra").alias("c_ra"), F.col("center.dec").alias("c_dec"), half.alias("radius"))
    asked = asked.filter("radius > 0")
    around = circles_around(asked, search_radius).filter(F.col("distance") < search_radius).drop("n", "i")
    first = asked.select("image_id", F.col("c_ra").alias("ra"), F.col("c_dec").alias("dec"), "radius", "c_ra", "c_dec", F.lit(-1e0).alias("distance"))
    # One picture's plan is bounded by (search radius / field radius)^2 circles.
    order = Window.partitionBy("image_id").orderBy("distance", "dec", "ra")
    found = around.unionByName(first).withColumn("run_id", F.row_number().over(order).cast("long") - 1)
    return found.select("image_id", "run_id", "ra", "dec", "radius", F.greatest("distance", F.lit(0e0)).alias("distance"))


def picture_stars(pictures: DataFrame, detector: Detector | None = None) -> DataFrame:
    """Stars of all readable pictures. ``detector``: any function of pixels (image_id, x, y, v) and
    sizes (image_id, image_width, image_height) to image_id, star_id, x, y, brightness, size; without
    one, pictures are decoded once and searched where they are decoded."""
    good = pictures.filter("error is null")
    if detector is None:
        return stash(detect_in_pictures(good), "stars")
    sizes = good.select("image_id", F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    return stash(detector(decode_pixels(good), sizes), "stars")


def solve_pictures(
    pictures: DataFrame, index: Index, options: SolveOptions = SolveOptions(), search_radius: float = 10.0,  # noqa: B008
    fallback: DataFrame | None = None, detector: Detector | None = None, progress: Progress | None = None,
) -> DataFrame:
    """``progress`` hears of the steps before quads (``search.STEPS``). A row for each picture: image_id, path, status (Success, Failure, Error), error, n_stars and the
    solution's columns. ``fallback``: run_id, ra, dec, radius of a plan for pictures without a hint, or
    without success there."""
    tell = progress or (lambda step, facts: None)
    tell("image_read_started", {})
    read = stash_observed(pictures, "pictures", errors=F.count("error"))
    pictures = read.table
    tell("image_read_finished", {"pictures": read.facts["n"], "errors": read.facts["errors"]})
    tell("star_detection_started", {})
    stars = picture_stars(pictures, detector)
    tell("star_detection_finished", {})
    sizes = pictures.filter("error is null").select("image_id", "width", "height")
    solved = stash(solve_first(stars, sizes, index, hinted_runs(pictures.filter("error is null"), search_radius), options), "solved")
    if fallback is not None:
        open_ = stash(sizes.join(solved, "image_id", "left_anti"), "open")
        if not open_.isEmpty():
            again = solve_first(stars.join(open_, "image_id", "left_semi"), open_, index, fallback, options)
            solved = solved.unionByName(stash(again, "solved"))
    counts = stars.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_stars"))
    out = pictures.select("image_id", "path", "error").join(counts, "image_id", "left").join(solved.select(*SOLUTION), "image_id", "left")
    status = F.when(F.col("error").isNotNull(), "Error").when(F.col("ra").isNotNull(), "Success").otherwise("Failure")
    return out.withColumns({"status": status, "n_stars": F.coalesce("n_stars", F.lit(0).cast("long"))})


def solve_files(spark: SparkSession, path: str | list[str], index: Index, **options) -> DataFrame:
    """``solve_pictures`` of all picture files under ``path``."""
    return solve_pictures(read_pictures(spark, path), index, **options)
