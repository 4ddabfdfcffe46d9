"""The 406 sky cells: their table, star assignment, intersection with circles, subdivision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import Value, col
from ..functions.sphere import angular_distance

#: Upper edges (degrees) and cell widths of the northern bands, from the pole down.
EDGES = (90.0, 80.1375, 70.2010, 60.1113, 50.2170, 40.5602, 30.1631, 20.7738, 10.2148, 0.0)
WIDTHS = (120, 40, 24, 18, 15, 12, 12, 10, 10)
#: band, bottom, top, cell width; the south mirrors the north.
BANDS = [(i, EDGES[i + 1], EDGES[i], w) for i, w in enumerate(WIDTHS)]
BANDS += [(17 - i, -top, -bottom + 0.0, w) for i, bottom, top, w in reversed(BANDS)]


def cell_id(band: Value, cell: Value) -> Column:
    return F.format_string("b%02dc%02d", col(band), col(cell))


def sky_cells(spark: SparkSession) -> DataFrame:
    """band, cell, cell_id, cell_num, ra_left, ra_right, dec_bottom, dec_top: 406 rows."""
    rows = ", ".join(f"({band}, {bottom!r}D, {top!r}D, {width})" for band, bottom, top, width in BANDS)
    bands = spark.sql(f"SELECT * FROM VALUES {rows} AS t(band, dec_bottom, dec_top, width)")
    cells = bands.withColumn("cell", F.explode(F.sequence(F.lit(0), (F.lit(360) / F.col("width")).cast("int") - 1)))
    left = (F.col("cell") * F.col("width")).cast("double")
    return cells.select(
        "band", "cell", cell_id("band", "cell").alias("cell_id"), (F.col("band") * 1000 + F.col("cell")).alias("cell_num"),
        left.alias("ra_left"), (left + F.col("width")).alias("ra_right"), "dec_bottom", "dec_top",
    )


def add_bounds_center(bounds: DataFrame) -> DataFrame:
    """center_ra, center_dec, width_deg (great circle at the center's Dec) and height_deg."""
    out = bounds.withColumns({
        "center_ra": F.col("ra_left") + (F.col("ra_right") - F.col("ra_left")) / 2,
        "center_dec": F.col("dec_bottom") + (F.col("dec_top") - F.col("dec_bottom")) / 2,
    })
    return out.withColumns({
        "width_deg": angular_distance("ra_left", "center_dec", "ra_right", "center_dec"),
        "height_deg": F.col("dec_top") - F.col("dec_bottom"),
    })


def star_band(dec: Value) -> Column:
    """Band with bottom < dec <= top; the last one also holds Dec -90 (it would fall into the first)."""
    dec, out = col(dec), None
    for band, bottom, _, _ in BANDS[:-1]:
        out = F.when(dec > bottom, band) if out is None else out.when(dec > bottom, band)
    return out.otherwise(BANDS[-1][0])


def star_cell(ra: Value, dec: Value) -> tuple[Column, Column]:
    """(band, cell) of a position, in closed form: no join. RA counts modulo 360."""
    band = star_band(dec)
    width = F.element_at(F.array(*[F.lit(w) for _, _, _, w in BANDS]), band + 1)
    return band, F.floor(F.pmod(col(ra), F.lit(360e0)) / width).cast("int")


def assign_cells(stars: DataFrame, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Adds band, cell and cell_id to every star."""
    band, cell = star_cell(ra, dec)
    return stars.withColumns({"band": band, "cell": cell}).withColumn("cell_id", cell_id("band", "cell"))


def circle_meets_cell(radius: Value, ra: Value, dec: Value) -> Column:
    """Whether a circle meets the cell in ra_left, ra_right, dec_bottom, dec_top. Circles over a
    pole meet all cells at it, in the south as in the north."""
    radius, ra, dec = col(radius), col(ra), col(dec)
    left, right, bottom, top = (F.col(c) for c in ("ra_left", "ra_right", "dec_bottom", "dec_top"))
    near_dec = F.greatest(bottom, F.least(dec, top))
    near_dec = F.when((dec + radius >= 90) & (top == 90), F.lit(90e0)).when((dec - radius <= -90) & (bottom == -90), F.lit(-90e0)).otherwise(near_dec)

    def turn(edge: Column) -> Column:
        d = F.abs(ra - edge) % 360
        return F.when(d > 180, F.lit(360e0) - d).otherwise(d)

    near_ra = F.when((ra > left) & (ra < right), ra).when(turn(left) < turn(right), left).otherwise(right)
    apart = (top < dec - radius) | (bottom > dec + radius)
    at_center = (near_ra == ra) & (near_dec == dec)
    return ~apart & (at_center | (radius - angular_distance(ra, dec, near_ra, near_dec) > 0))


def inside(ra: Value, dec: Value) -> Column:
    """Containment in a box, inclusive on all four sides."""
    return col(ra).between(F.col("ra_left"), F.col("ra_right")) & col(dec).between(F.col("dec_bottom"), F.col("dec_top"))


def runs_to_cells(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The cells that each search circle (ra, dec, radius) meets. The cell table is a constant of
    406 rows, so it is broadcast."""
    cells = F.broadcast(sky_cells(runs.sparkSession))
    return runs.join(cells, circle_meets_cell("radius", "ra", "dec")).select(*keys, "cell_id", "band", "cell")


def subdivide(cells: DataFrame, divisions: Value) -> DataFrame:
    """Subcell boxes of every row: subcell counts RA within Dec, from the lower left."""
    d = col(divisions)
    out = cells.withColumn("_d", d).withColumn("subcell", F.explode(F.sequence(F.lit(0), F.col("_d") * F.col("_d") - 1)))
    wide = (F.col("ra_right") - F.col("ra_left")) / F.col("_d")
    high = (F.col("dec_top") - F.col("dec_bottom")) / F.col("_d")
    across, up = (F.col("subcell") % F.col("_d")).cast("int"), F.floor(F.col("subcell") / F.col("_d")).cast("int")
    out = out.withColumns({"_w": wide, "_h": high, "_i": across, "_j": up, "_left": F.col("ra_left"), "_bottom": F.col("dec_bottom")})
    return out.withColumns({
        "ra_left": F.col("_left") + F.col("_i") * F.col("_w"),
        "ra_right": F.col("_left") + (F.col("_i") + 1) * F.col("_w"),
        "dec_bottom": F.col("_bottom") + F.col("_j") * F.col("_h"),
        "dec_top": F.col("_bottom") + (F.col("_j") + 1) * F.col("_h"),
    }).drop("_d", "_w", "_h", "_i", "_j", "_left", "_bottom")
