"""Star detection on rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import with_sql
from ..operators import detect
from ..storage import new_folder, stash
from ..streaming import queue
from .base import Registry, fixture, r6

REGISTRY = Registry()
A = REGISTRY.add
OFFSET = 1.0  # the fixture's rasters are noise: a low threshold gives components to measure

_HIST = with_sql("pixels") + ", hist AS (SELECT image_id, v, count(*) AS n FROM pixels GROUP BY image_id, v)"
_LEVELS = _HIST + f""",
    sums AS (SELECT image_id, CAST(sum(n) AS BIGINT) AS c, CAST(sum(n*v) AS BIGINT) AS s1, CAST(sum(n*v*v) AS BIGINT) AS s2 FROM hist GROUP BY image_id),
    means AS (SELECT *, s1//c AS mean FROM sums),
    levels AS (SELECT image_id, mean, sqrt(CAST(s2 - 2*mean*s1 + mean*mean*c AS DOUBLE)/c) AS std, mean + CAST(floor(sqrt(CAST(s2 - 2*mean*s1 + mean*mean*c AS DOUBLE)/c)*{OFFSET}) AS BIGINT) AS flat FROM means WHERE mean <> 0)"""
_BRIGHT = _LEVELS + ", bright AS (SELECT p.* FROM pixels p JOIN levels l ON l.image_id = p.image_id WHERE v > flat)"
_RUNS = _BRIGHT + """,
    runs AS (SELECT image_id, y, min(x) AS l, max(x) AS r, y*4294967296 + min(x) AS run FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM bright) t GROUP BY image_id, y, g)"""
_EDGES = _RUNS + ", edges AS (SELECT a.image_id, a.run AS a, b.run AS b FROM runs a JOIN runs b ON a.image_id = b.image_id AND b.y = a.y + 1 AND b.l <= a.r + 1 AND b.r >= a.l - 1)"
# Labels spread from every run over its links; the least one to reach a run names its component.
_COMPONENTS = _EDGES.replace("WITH ", "WITH RECURSIVE ", 1) + """,
    both_ways AS (SELECT image_id, a, b FROM edges UNION ALL SELECT image_id, b, a FROM edges),
    reach AS (SELECT image_id, run, run AS label FROM runs UNION SELECT e.image_id, e.b, r.label FROM reach r JOIN both_ways e ON e.image_id = r.image_id AND e.a = r.run),
    labels AS (SELECT image_id, run, min(label) AS component FROM reach GROUP BY image_id, run),
    labelled AS (SELECT p.*, l.component FROM bright p JOIN runs r ON r.image_id = p.image_id AND r.y = p.y AND p.x BETWEEN r.l AND r.r JOIN labels l ON l.image_id = r.image_id AND l.run = r.run)"""
_MEASURED = _COMPONENTS + """,
    placed AS (SELECT *, row_number() OVER (PARTITION BY image_id, component ORDER BY v, y, x) - 1 AS i, count(*) OVER (PARTITION BY image_id, component) AS n FROM labelled),
    measured AS (
        SELECT image_id, component, min(x) AS l, max(x) AS r, min(y) AS t, max(y) AS b, count(*) AS n_pixels, count(DISTINCT y) AS height, max(x) - min(x) + 1 AS width, max(v) AS brightness,
               min(x) FILTER (n <= 9 OR i >= ceil(n*0.5e0)) AS x0, max(x) FILTER (n <= 9 OR i >= ceil(n*0.5e0)) AS x1,
               min(y) FILTER (n <= 9 OR i >= ceil(n*0.5e0)) AS y0, max(y) FILTER (n <= 9 OR i >= ceil(n*0.5e0)) AS y1
        FROM placed GROUP BY image_id, component)"""
_TOO_LARGE = "(width > floor(64*0.02e0*{k}) OR height > floor(64*0.02e0*{k}))"
_STREAK = "(width = 1 OR height = 1 OR CAST(CAST(width AS FLOAT)/CAST(height AS FLOAT) AS FLOAT) >= 6 OR CAST(CAST(height AS FLOAT)/CAST(width AS FLOAT) AS FLOAT) >= 6)"
_NOT_ROUND = "(n_pixels*4*pi()/((pi()*greatest(width, height))*(pi()*greatest(width, height))) < 0.25e0)"


def pixels(spark, sf_dir):
    return fixture(spark, sf_dir, "pixels")


def levels(spark, sf_dir):
    return detect.background(detect.histogram(pixels(spark, sf_dir)), OFFSET)


def bright(spark, sf_dir):
    return detect.bright_pixels(pixels(spark, sf_dir), levels(spark, sf_dir))


def measured(spark, sf_dir):
    return detect.measure_components(detect.component_pixels(stash(bright(spark, sf_dir), "bright")))


@A("agg_01_histogram", _HIST + " SELECT * FROM hist")
def agg_01(spark, sf_dir):
    return detect.histogram(pixels(spark, sf_dir))


@A("agg_02_histogram_peak", _HIST + " SELECT image_id, v AS peak, n FROM hist QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, v) = 1")
def agg_02(spark, sf_dir):
    return detect.histogram_peak(detect.histogram(pixels(spark, sf_dir)))


@A("agg_03_background", _LEVELS + " SELECT image_id, mean, round(std, 6) AS std, flat FROM levels")
def agg_03(spark, sf_dir):
    return levels(spark, sf_dir).withColumn("std", r6(F.col("std")))


@A("flt_02_bright_pixels", _BRIGHT + " SELECT image_id, x, y, v FROM bright")
def flt_02(spark, sf_dir):
    return bright(spark, sf_dir).select("image_id", "x", "y", "v")


@A("win_08_pixel_runs", _RUNS + " SELECT image_id, y, l AS \"left\", r AS \"right\" FROM runs")
def win_08(spark, sf_dir):
    return detect.pixel_runs(bright(spark, sf_dir))


@A("join_15_touching_runs", _EDGES + " SELECT * FROM edges")
def join_15(spark, sf_dir):
    return detect.run_links(detect.numbered_runs(bright(spark, sf_dir)))


@A("agg_04_components", _COMPONENTS + " SELECT image_id, x, y, v, component FROM labelled")
def agg_04(spark, sf_dir):
    return detect.component_pixels(stash(bright(spark, sf_dir), "bright")).select("image_id", "x", "y", "v", "component")


@A("agg_05_bounding_boxes", _MEASURED + " SELECT image_id, component, l AS \"left\", r AS \"right\", t AS top, b AS bottom FROM measured")
def agg_05(spark, sf_dir):
    return measured(spark, sf_dir).select("image_id", "component", "left", "right", "top", "bottom")


@A("agg_06_component_centers", _MEASURED + " SELECT image_id, component, x0 + (x1 - x0)*0.5e0 AS x, y0 + (y1 - y0)*0.5e0 AS y, brightness, round(sqrt(CAST((r-l)*(r-l) + (b-t)*(b-t) AS DOUBLE)), 6) AS size FROM measured")
def agg_06(spark, sf_dir):
    return measured(spark, sf_dir).select("image_id", "component", "x", "y", "brightness", r6(F.col("size")).alias("size"))


@A("agg_07_component_sizes", _MEASURED + " SELECT image_id, component, n_pixels, width, height FROM measured")
def agg_07(spark, sf_dir):
    return measured(spark, sf_dir).select("image_id", "component", "n_pixels", "width", "height")


def _shape(name, sql, condition):
    @A(name, _MEASURED + f" SELECT image_id, component FROM measured WHERE {sql}")
    def run(spark, sf_dir):
        return measured(spark, sf_dir).filter(condition()).select("image_id", "component")


_shape("flt_04_too_small", "n_pixels < 4", detect.too_small)
_shape("flt_05_too_large", _TOO_LARGE.format(k=10), lambda: detect.too_large(F.lit(640), F.lit(640)))
_shape("flt_06_streak", _STREAK, detect.streak)
_shape("flt_07_not_round", _NOT_ROUND, detect.not_round)
_STAR = f"n_pixels >= 4 AND NOT {_TOO_LARGE.format(k=10)} AND NOT {_STREAK} AND NOT {_NOT_ROUND}"
_shape("flt_03_star_shape", _STAR, lambda: detect.star_shape(F.lit(640), F.lit(640)))


@A("sol_12_detect_stars", _MEASURED + f" SELECT image_id, component AS star_id, x0 + (x1 - x0)*0.5e0 AS x, y0 + (y1 - y0)*0.5e0 AS y, brightness FROM measured WHERE {_STAR}")
def sol_12(spark, sf_dir):
    found = pixels(spark, sf_dir)
    sizes = found.select("image_id").distinct().withColumns({"image_width": F.lit(640), "image_height": F.lit(640)})
    return detect.detect_stars(found, sizes, OFFSET).select("image_id", "star_id", "x", "y", "brightness")


@A("prj_01_as_stars", _MEASURED + " SELECT image_id, component AS star_id, x0 + (x1 - x0)*0.5e0 AS x, y0 + (y1 - y0)*0.5e0 AS y, brightness, round(sqrt(CAST((r-l)*(r-l) + (b-t)*(b-t) AS DOUBLE)), 6) AS size FROM measured")
def prj_01(spark, sf_dir):
    found = detect.as_stars(measured(spark, sf_dir))
    return found.withColumn("size", r6(F.col("size")))


def pictures_of(found):
    """A row per picture with its samples as 16-bit values, as picture files give them."""
    order = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    rows = found.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), order.alias("s"))
    return rows.select("image_id", "width", "height", F.lit(16).alias("bits"), F.unhex(F.array_join(F.transform("s", lambda p: _big_endian(p["v"])), "")).alias("data"))


def _big_endian(v):
    """A sample, moved down as signed ones are, in hexadecimal digits."""
    return F.lpad(F.hex((v + 32768) % 65536), 4, "0")


@A("sol_12_detect_in_pictures", _MEASURED + f" SELECT image_id, component AS star_id, x0 + (x1 - x0)*0.5e0 AS x, y0 + (y1 - y0)*0.5e0 AS y, brightness FROM measured WHERE {_STAR}")
def sol_12_in_pictures(spark, sf_dir):
    """Each picture decoded once, and labelled where it is decoded."""
    found = pictures_of(pixels(spark, sf_dir))
    shape = lambda width, height: detect.star_shape(F.lit(640), F.lit(640))
    return detect.detect_in_pictures(found, OFFSET, shape).select("image_id", "star_id", "x", "y", "brightness")


def _read_texts(spark, paths):
    """A picture format of a line of text, for want of a writer of binary files: width, height, samples."""
    rows = spark.read.format("binaryFile").load(paths)
    parts = F.split(F.btrim(F.decode("content", "UTF-8"), F.lit(" \n")), "[ \n]+")
    numbers = F.transform(F.slice(parts, F.lit(3), F.size(parts)), lambda v: _big_endian(v.cast("long")))
    found = rows.select("path", parts[0].cast("long").alias("width"), parts[1].cast("long").alias("height"), F.lit(16).alias("bits"), F.unhex(F.array_join(numbers, "")).alias("data"))
    none = {"center": "struct<ra: double, dec: double>", "view": "struct<width_deg: double, height_deg: double>", "error": "string"}
    return found.withColumns({k: F.lit(None).cast(t) for k, t in none.items()} | {"image_id": F.xxhash64("path")})


@A("str_07_prepared_jobs", _MEASURED + f", pics AS (SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height FROM pixels GROUP BY image_id), counts AS (SELECT image_id, count(*) AS n FROM measured WHERE {_STAR} GROUP BY image_id) SELECT p.image_id, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, coalesce(n, 0) AS n_stars FROM pics p LEFT JOIN counts c ON c.image_id = p.image_id")
def str_07(spark, sf_dir):
    """Every picture is written as a file, found by the stream, and becomes a job with its stars counted."""
    order = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    texts = pixels(spark, sf_dir).groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), order.alias("s"))
    texts = texts.select("image_id", F.concat_ws(" ", "w", "h", F.array_join(F.transform("s", lambda p: p["v"].cast("string")), " ")).alias("value"))
    inbox = new_folder(spark, "inbox")
    texts.repartition("image_id").write.partitionBy("image_id").text(inbox)
    folders = queue.create(spark, new_folder(spark, "queue"))
    detector = lambda px, sizes: detect.detect_stars(px, sizes.withColumns({"image_width": F.lit(640), "image_height": F.lit(640)}), OFFSET)
    queue.prepare_jobs(spark, f"{inbox}/*", folders, 100, detector, _read_texts).awaitTermination()
    jobs = queue.prepared(spark, folders)
    return jobs.select(F.regexp_extract("path", r"image_id=(\d+)", 1).cast("long").alias("image_id"), "width", "height", "n_stars")
