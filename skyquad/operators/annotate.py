"""What a desktop view draws over a solved picture, as tables: objects, grid lines, stars, stretch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import position_label
from ..functions.base import Value, col
from ..functions.plate import sky_to_pixel
from ..functions.sphere import angular_distance

POINTS = 5  # interpolated between two grid crossings


def object_name() -> Column:
    """Name, or else first, or else second catalog number."""
    one = F.concat_ws(" ", F.nullif("cat1", F.lit("")), F.nullif("id1", F.lit("")))
    has = (F.coalesce("cat1", F.lit("")) != "") & (F.coalesce("id1", F.lit("")) != "")
    return F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).when(has, one).otherwise(F.concat_ws(" ", "cat2", "id2"))


def _tile(dec_band: Column) -> Column:
    """Number of tiles around the sky of a band of one degree, each some degree wide."""
    edge = F.when(dec_band >= 0, dec_band).otherwise(dec_band + 1)
    return F.greatest(F.lit(1).cast("long"), F.floor(F.cos(F.radians(edge)) * 360))


def _tiles_of_circles(circles: DataFrame) -> DataFrame:
    """A row for each tile that a circle (c_ra, c_dec, c_radius) may meet, in closed form. Margins of a
    thousandth of a degree, by far above rounding; the distance decides later."""
    asked = circles.filter(~(F.isnan("c_ra") | F.isnan("c_dec") | F.isnan("c_radius")) & (F.col("c_radius") >= 0))
    band = lambda dec: F.greatest(F.lit(-90).cast("long"), F.least(F.lit(89).cast("long"), F.floor(dec)))
    out = asked.withColumn("_band", F.explode(F.sequence(band(F.col("c_dec") - F.col("c_radius") - 1e-3), band(F.col("c_dec") + F.col("c_radius") + 1e-3))))
    d, r = F.radians("c_dec"), F.radians("c_radius")
    # The circle is widest at this Dec, or at the edge of the band next to it.
    widest = F.when((F.col("c_radius") >= 90) | (F.abs(F.sin(d)) >= F.cos(r)), F.signum("c_dec") * 90).otherwise(F.degrees(F.asin(F.greatest(F.lit(-1e0), F.least(F.lit(1e0), F.try_divide(F.sin(d), F.cos(r)))))))
    at = F.radians(F.greatest(F.col("_band").cast("double"), F.least(F.col("_band") + 1e0, widest)))
    below = F.cos(d) * F.cos(at)
    turned = F.try_divide(F.cos(r) - F.sin(d) * F.sin(at), below)
    wide = F.when((F.col("c_radius") >= 90) | (below < 1e-4), F.lit(180e0)).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1e0), F.least(F.lit(1e0), turned)))) + 1e-3)
    out = out.withColumns({"_wide": wide, "_n": _tile(F.col("_band"))})
    first, last = (F.floor((F.col("c_ra") + s * F.col("_wide")) / 360 * F.col("_n")) for s in (-1, 1))
    out = out.withColumns({"_first": first, "_last": F.least(last, first + F.col("_n") - 1)})
    out = out.withColumn("_at", F.explode(F.sequence("_first", "_last")))
    return out.withColumn("_at", F.pmod("_at", "_n")).drop("_wide", "_n", "_first", "_last")


def objects_in_radius(objects: DataFrame, circles: DataFrame) -> DataFrame:
    """Objects (ra, dec) within each circle (run_id, ra, dec, radius). Circles become the tiles they meet,
    of some square degree each, so that the join is one on tiles and few objects outside of a circle are
    met; the distance decides. Poles and the RA seam need no special case. Neither side is broadcast, as
    Spark sizes circles before they become tiles; both are dealt by number, as few bytes make much work."""
    parts = int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = lambda ra, dec, p: {f"_{p}r": F.radians(ra), f"_{p}s": F.sin(F.radians(dec)), f"_{p}c": F.cos(F.radians(dec))}
    asked = circles.select("run_id", *[F.col(c).cast("double").alias(f"c_{c}") for c in ("ra", "dec", "radius")])
    asked = _tiles_of_circles(asked.withColumns(sides("c_ra", "c_dec", "c"))).repartition(parts, "_band", "_at")
    band = F.greatest(F.lit(-90).cast("long"), F.least(F.lit(89).cast("long"), F.floor("dec")))
    placed = objects.filter(F.col("ra").isNotNull() & F.col("dec").isNotNull()).withColumns({"_band": band} | sides("ra", "dec", "o"))
    placed = placed.withColumn("_at", F.least(_tile(F.col("_band")) - 1, F.floor(F.pmod("ra", F.lit(360e0)) / 360 * _tile(F.col("_band"))))).repartition(parts, "_band", "_at")
    # angular_distance, with what belongs to one side alone computed there.
    cosine = F.col("_os") * F.col("_cs") + F.col("_oc") * F.col("_cc") * F.cos(F.col("_or") - F.col("_cr"))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1e0), F.least(F.lit(1e0), cosine))))
    distance = F.when((F.col("ra") == F.col("c_ra")) & (F.col("dec") == F.col("c_dec")), F.lit(0e0)).otherwise(angle)
    met = asked.join(placed.hint("merge"), ["_band", "_at"]).filter(F.abs(F.col("dec") - F.col("c_dec")) <= F.col("c_radius") + 1e-3)
    return met.withColumn("distance", distance).filter(F.col("distance") <= F.col("c_radius")).select("run_id", *objects.columns, "distance")


def pole_visible() -> Column:
    """Whether a pole lies inside a solved picture."""
    out = F.lit(False)
    for dec in (90e0, -90e0):
        x, y = sky_to_pixel(F.lit(0e0), F.lit(dec))
        out = out | ((x > 0) & (x < F.col("width")) & (y > 0) & (y < F.col("height")))
    return out


def grid_interval(radius: Value, pole: Value) -> tuple[Column, Column]:
    """Spacing of (RA, Dec) lines. Fixed values, by field radius."""
    radius = col(radius)

    def steps(at_pole: float, widest: float) -> Column:
        out = F.when(col(pole), F.lit(at_pole)).when(radius > 10, F.lit(widest))
        for least, step in ((5, 5e0), (2, 2e0), (1, 1e0), (0.5, 0.5)):
            out = out.when(radius > least, F.lit(step))
        return out.otherwise(F.lit(0.25))

    return steps(30e0, 15e0), steps(0.5, 10e0)


def grid_points(solved: DataFrame) -> DataFrame:
    """Points of the grid lines within twice the radius of each solution: image_id, line ('ra' has
    a fixed Dec, 'dec' a fixed RA), line_value, ra, dec. ``solved`` needs image_id, ra, dec, radius
    and pole (whether a pole is visible). Only lines near the picture are generated."""
    ra_step, dec_step = grid_interval("radius", "pole")
    base = solved.select("image_id", F.col("ra").alias("c_ra"), F.col("dec").alias("c_dec"), F.col("radius").alias("c_radius"), ra_step.alias("ra_step"), dec_step.alias("dec_step"))
    fine = float(POINTS + 1)

    def numbers(last: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), last))

    turns, halves = F.floor(F.lit(360e0) / F.col("ra_step")), F.floor(F.lit(180e0) / F.col("dec_step"))
    reach = F.col("c_radius") * 2e0
    low = F.greatest(F.lit(0).cast("long"), F.floor((F.col("c_dec") - reach + 90e0) / F.col("dec_step")).cast("long"))
    high = F.least(halves, F.ceil((F.col("c_dec") + reach + 90e0) / F.col("dec_step")).cast("long"))
    # Lines of RA: whole steps of RA, fine steps of Dec; no line repeats at 360.
    along_dec = base.withColumn("i", numbers(turns - 1)).withColumn("j", F.explode(F.sequence(low * (POINTS + 1), high * (POINTS + 1))))
    along_dec = along_dec.select("*", F.lit("dec").alias("line"), (F.col("i") * F.col("ra_step")).alias("ra"), (F.col("j") * (F.col("dec_step") / fine) - 90e0).alias("dec"))
    # Lines of Dec, without the poles, closed at 360.
    low_line = F.greatest(low, F.lit(1).cast("long"))
    high_line = F.least(high, halves - 1)
    along_ra = base.filter(low_line <= high_line).withColumn("j", F.explode(F.sequence(low_line, high_line))).withColumn("i", numbers(turns * (POINTS + 1)))
    along_ra = along_ra.select("*", F.lit("ra").alias("line"), (F.col("i") * (F.col("ra_step") / fine)).alias("ra"), (F.col("j") * F.col("dec_step") - 90e0).alias("dec"))
    points = along_dec.unionByName(along_ra)
    near = points.filter(angular_distance("ra", "dec", "c_ra", "c_dec") <= reach)
    value = F.when(F.col("line") == "dec", F.col("ra")).otherwise(F.col("dec"))
    return near.select("image_id", "line", value.alias("line_value"), "ra", "dec")


def grid_lines(points: DataFrame) -> DataFrame:
    """One row per line, with its points in order."""
    along = F.when(F.col("line") == "dec", F.col("dec")).otherwise(F.col("ra"))
    spots = F.array_sort(F.collect_list(F.struct(along.alias("along"), "ra", "dec")))
    return points.groupBy("image_id", "line", "line_value").agg(spots.alias("points"))


def quad_outlines(quads: DataFrame, stars: DataFrame) -> DataFrame:
    """The four sides of each picture quad: image_id, quad_id, side, x1, y1, x2, y2. ``quads``: image_id,
    quad_id, mid_x, mid_y, star_ids; ``stars``: image_id, star_id, x, y. Corners go round the middle by their
    angle, so that sides don't cross."""
    corners = quads.select("image_id", "quad_id", "mid_x", "mid_y", F.explode("star_ids").alias("star_id")).join(stars.select("image_id", "star_id", "x", "y"), ["image_id", "star_id"])
    angle = F.atan2(F.col("y") - F.col("mid_y"), F.col("x") - F.col("mid_x"))
    around = corners.groupBy("image_id", "quad_id").agg(F.array_sort(F.collect_list(F.struct(angle.alias("angle"), "star_id", "x", "y"))).alias("c"))
    n = F.size("c")
    side = lambda p, i: F.struct(i.alias("side"), p["x"].alias("x1"), p["y"].alias("y1"), F.get("c", (i + 1) % n)["x"].alias("x2"), F.get("c", (i + 1) % n)["y"].alias("y2"))
    return around.select("image_id", "quad_id", F.explode(F.transform("c", side)).alias("s")).select("image_id", "quad_id", "s.*")


def match_marks(matches: DataFrame, quads: DataFrame) -> DataFrame:
    """What stands at the middle of each matched quad: its text (scale and place in the sky) and, for each
    ratio, a level from 0.1 to 0.9 that rings are colored by."""
    levels = F.array(*[F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.round(F.col(f"r{i}").cast("double"), 1))) for i in range(5)])
    own = quads.select("image_id", "quad_id", "mid_x", "mid_y", levels.alias("levels"))
    text = F.concat(F.round("scale_ratio", 1).cast("string"), F.lit(" | "), position_label("mid_ra", "mid_dec", 3))
    return matches.select("image_id", "run_id", "quad_id", text.alias("text")).join(own, ["image_id", "quad_id"])


def star_marks(stars: DataFrame, radius: float = 8.0) -> DataFrame:
    """A circle around each star."""
    return stars.select("image_id", "star_id", "x", "y", F.lit(float(radius)).alias("radius"))


def crosshairs(pictures: DataFrame) -> DataFrame:
    """The two lines through the middle of each picture: image_id, line, x1, y1, x2, y2."""
    right, bottom, zero = (F.col("width") - 1).cast("double"), (F.col("height") - 1).cast("double"), F.lit(0e0)
    lines = [("upright", right / 2, zero, right / 2, bottom), ("level", zero, bottom / 2, right, bottom / 2)]
    every = F.array(*[F.struct(F.lit(n).alias("line"), *[v.alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), at, strict=True)]) for n, *at in lines])
    return pictures.select("image_id", F.explode(every).alias("l")).select("image_id", "l.*")


def clipped(segments: DataFrame) -> DataFrame:
    """Segments (x1, y1, x2, y2, width, height) cut to the frame from 0 to width and height; those outside
    are left out. A segment's points are x1 + t (x2 - x1): each edge bounds t from one side."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    edges = [(-dx, F.col("x1")), (dx, F.col("width") - F.col("x1")), (-dy, F.col("y1")), (dy, F.col("height") - F.col("y1"))]
    inside = F.lit(True)
    enters, leaves = [F.lit(0e0)], [F.lit(1e0)]
    for p, q in edges:
        inside = inside & ((p != 0) | (q >= 0))
        at = F.try_divide(q, p)
        enters.append(F.when(p < 0, at).otherwise(0e0))
        leaves.append(F.when(p > 0, at).otherwise(1e0))
    found = segments.withColumns({"_in": F.greatest(*enters), "_out": F.least(*leaves), "_ok": inside}).filter("_ok and _in <= _out")
    at = {f"{c}{k}": F.col(f"{c}1") + F.col(t) * (F.col(f"{c}2") - F.col(f"{c}1")) for c in "xy" for k, t in ((1, "_in"), (2, "_out"))}
    return found.withColumns(at).drop("_in", "_out", "_ok")


def line_intersection(s1: tuple, e1: tuple, s2: tuple, e2: tuple) -> tuple[Column, Column]:
    """Crossing of two lines given by two points each; null where they are parallel."""
    a1, b1 = e1[1] - s1[1], s1[0] - e1[0]
    a2, b2 = e2[1] - s2[1], s2[0] - e2[0]
    c1, c2 = a1 * s1[0] + b1 * s1[1], a2 * s2[0] + b2 * s2[1]
    delta = F.nullif(a1 * b2 - a2 * b1, F.lit(0e0))
    return (b2 * c1 - b1 * c2) / delta, (a1 * c2 - a2 * c1) / delta


def in_picture(x: Value, y: Value, width: Value, height: Value) -> Column:
    x, y = col(x), col(y)
    return (x >= 0) & (x < col(width)) & (y >= 0) & (y < col(height))


def edge_crossings(points: DataFrame) -> DataFrame:
    """Steps of a polyline that leave or enter the picture. ``points``: image_id, line, line_value,
    along, x, y, width, height."""
    order = Window.partitionBy("image_id", "line", "line_value").orderBy("along")
    stepped = points.withColumns({"_px": F.lag("x").over(order), "_py": F.lag("y").over(order)}).filter("_px is not null")
    here, there = in_picture("x", "y", "width", "height"), in_picture("_px", "_py", "width", "height")
    return stepped.filter(here != there).select("image_id", "line", "line_value", "along", F.col("_px").alias("x1"), F.col("_py").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"), here.alias("enters"))


def luminance_level(red: Value, green: Value, blue: Value, levels: int = 256) -> Column:
    """BT.709 luminance of channels between 0 and 1, as a whole level, halves to even."""
    return F.rint((col(red) * 0.2126 + col(green) * 0.7152 + col(blue) * 0.0722) * float(levels - 1)).cast("int")


def stretch_parameters(counts: DataFrame, levels: int = 256) -> DataFrame:
    """Midtones and shadows of each picture from its level histogram (image_id, level, n). The
    median is the level in the middle of all levels ordered by their frequency, and the deviation
    is taken over levels; ties, whose order the original leaves open, go by level."""
    pictures = counts.select("image_id").distinct()
    every = pictures.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).join(counts, ["image_id", "level"], "left").fillna(0, ["n"])
    by_count = F.row_number().over(Window.partitionBy("image_id").orderBy("n", "level"))
    median = every.withColumn("_i", by_count - 1).filter(F.col("_i") == levels // 2).select("image_id", F.col("level").alias("median"))
    off = every.join(median, "image_id").withColumn("off", F.abs(F.col("level") - F.col("median")))
    by_off = F.row_number().over(Window.partitionBy("image_id").orderBy("off", "level"))
    mad = off.withColumn("_i", by_off - 1).filter(F.col("_i") == levels // 2).select("image_id", "median", F.col("off").alias("mad"))
    spread = F.col("mad") / float(levels) * 1.4826
    shadows = F.greatest(F.lit(0e0), F.least(F.lit(1e0), F.col("median") / float(levels) - spread * 3.8))
    return mad.select("image_id", "median", "mad", shadows.alias("shadows"), (spread - shadows).alias("midtones"))
