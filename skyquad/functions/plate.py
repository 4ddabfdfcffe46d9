"""Plate solutions as columns: plate constants, WCS terms, pixel and sky transforms.

Plate constants a..f map pixels to negated standard coordinates around the plate's reference
position: ``X = a x + b y + c``, ``Y = d x + e y + f``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .angles import positive_ra
from .base import Value, col
from .sphere import from_plane, to_plane


def quads_per_square_degree(n_quads: Value, radius: Value, width: Value, height: Value) -> Column:
    """Expected density of image quads if the picture's half diagonal is ``radius``; truncated."""
    corner = F.atan(col(height) / col(width))
    field = col(radius) * 2e0
    return F.floor(col(n_quads) / ((field * F.sin(corner)) * (field * F.cos(corner)))).cast("long")


def pixel_distance(x: Value, y: Value, to_x: Value, to_y: Value) -> Column:
    dx, dy = col(x) - col(to_x), col(y) - col(to_y)
    return F.sqrt(dx * dx + dy * dy)


def view_diameter(width: Value, height: Value) -> Column:
    return F.hypot(col(width), col(height))


def diagonal(width: Value, height: Value) -> Column:
    width, height = col(width).cast("double"), col(height).cast("double")
    return F.sqrt(width * width + height * height)


def field_radius(arcsec_per_pixel: Value, width: Value, height: Value) -> Column:
    """Degrees from center to corner."""
    return diagonal(width, height) * 0.5 * col(arcsec_per_pixel) / 3600e0


def _turn(difference: Column) -> Column:
    """Wrapped to -180..180."""
    return F.when(difference > 180, difference - 360e0).when(difference < -180, difference + 360e0).otherwise(difference)


def add_wcs(solved: DataFrame) -> DataFrame:
    """Adds center and WCS columns. Needs ra0, dec0 (reference position), a..f, pixels_per_degree,
    width and height. RA differences of one-pixel steps are wrapped; crota stays 0 where either
    off-diagonal term is 0."""
    half_x, half_y = F.floor(F.col("width") / 2).cast("double"), F.floor(F.col("height") / 2).cast("double")
    steps = {"mid": (0, 0), "right": (1, 0), "up": (0, 1)}
    # One projection per step of the derivation: each value is computed once and generated code stays small.
    out = solved.withColumns({"_px": half_x, "_py": half_y})
    out = out.withColumns(
        {f"_x_{n}": F.col("a") * (F.col("_px") + dx) + F.col("b") * (F.col("_py") + dy) + F.col("c") for n, (dx, dy) in steps.items()}
        | {f"_y_{n}": F.col("d") * (F.col("_px") + dx) + F.col("e") * (F.col("_py") + dy) + F.col("f") for n, (dx, dy) in steps.items()}
    )
    raw = {n: from_plane("ra0", "dec0", f"_x_{n}", f"_y_{n}", wrap=False) for n in steps}
    out = out.withColumns({f"_ra_{n}": v[0] for n, v in raw.items()} | {f"_dec_{n}": v[1] for n, v in raw.items()})
    out = out.withColumns({f"_ra_{n}": positive_ra(f"_ra_{n}") for n in steps})
    out = out.withColumns({"_east": F.col("_ra_right") - F.col("_ra_mid"), "_north": F.col("_ra_up") - F.col("_ra_mid")})
    shrink = F.cos(F.radians("_dec_mid"))
    out = out.withColumns({
        "ra": F.col("_ra_mid"),
        "dec": F.col("_dec_mid"),
        "cd1_1": _turn(F.col("_east")) * shrink,
        "cd2_1": F.col("_dec_right") - F.col("_dec_mid"),
        "cd1_2": _turn(F.col("_north")) * shrink,
        "cd2_2": F.col("_dec_up") - F.col("_dec_mid"),
    })
    cd = [F.col(f"cd{i}_{j}") for i, j in ((1, 1), (1, 2), (2, 1), (2, 2))]
    out = out.withColumn("_sign", F.when(cd[0] * cd[3] - cd[1] * cd[2] < 0, F.lit(-1e0)).otherwise(F.lit(1e0)))
    sign, turned = F.col("_sign"), (cd[2] != 0) & (cd[1] != 0)
    ratio = -F.col("a") / F.col("d")
    out = out.withColumn("_ref_y", (-(ratio * F.col("f")) - F.col("c")) / (F.col("b") + ratio * F.col("e")))
    py = F.col("_ref_y")
    size = diagonal("width", "height")
    out = out.withColumns({
        "crota1": F.when(turned, F.degrees(F.atan2(sign * cd[1], cd[3]))).otherwise(0e0),
        "crota2": F.when(turned, -F.degrees(F.atan2(cd[2], sign * cd[0]))).otherwise(0e0),
        "cdelt1": F.when(turned, sign * F.sqrt(cd[0] * cd[0] + cd[2] * cd[2])).otherwise(cd[0]),
        "cdelt2": F.when(turned, F.sqrt(cd[1] * cd[1] + cd[3] * cd[3])).otherwise(cd[3]),
        "crval1": F.col("ra0"),
        "crval2": F.col("dec0"),
        "crpix1": (-F.col("b") * py - F.col("c")) / F.col("a"),
        "crpix2": py,
        "parity": F.when(sign < 0, "normal").otherwise("flipped"),
        "field_width": F.col("width") / F.col("pixels_per_degree"),
        "field_height": F.col("height") / F.col("pixels_per_degree"),
        "radius": size * 0.5 / F.col("pixels_per_degree"),
        "pix_scale": F.lit(3600e0) / F.col("pixels_per_degree"),
    })
    return out.withColumn("orientation", F.col("crota1")).drop(*[c for c in out.columns if c.startswith("_")])


def pixel_to_sky(x: Value, y: Value) -> tuple[Column, Column]:
    """Sky position of a pixel, from the columns of a solution."""
    dx, dy = col(x) - F.floor(F.col("width") / 2), col(y) - F.floor(F.col("height") / 2)
    east = F.radians(F.col("cd1_1") * dx + F.col("cd1_2") * dy)
    north = F.radians(F.col("cd2_1") * dx + F.col("cd2_2") * dy)
    middle = F.radians("dec")
    d = F.cos(middle) - north * F.sin(middle)
    g = F.sqrt(east * east + d * d)
    ra = F.col("ra") + F.degrees(F.atan2(east, d))
    return ra, F.degrees(F.atan((F.sin(middle) + north * F.cos(middle)) / g))


def pixel_positions(x: Value, y: Value) -> tuple[Column, Column]:
    """RA and Dec of pixels by a solution's plate constants (columns a to f, ra0, dec0), without the
    detour over the linear terms at its center."""
    x, y = col(x), col(y)
    return from_plane("ra0", "dec0", F.col("a") * x + F.col("b") * y + F.col("c"), F.col("d") * x + F.col("e") * y + F.col("f"))


def sky_to_pixel(ra: Value, dec: Value, mirrored: bool = True) -> tuple[Column, Column]:
    """Pixel of a sky position, halves rounded to even. ``mirrored`` reads the point back through
    the image's center, which is exact only where that is the reference position; without it the
    plate equations are solved as they are."""
    x, y = to_plane(ra, dec, "ra0", "dec0")
    if not mirrored:
        x, y = -x, -y
    a, b, c, d, e, f = (F.col(n) for n in "abcdef")
    zero = F.lit(0e0)
    # Elimination by -a / d; where d is exactly 0 or a is, as in plates without rotation, by determinants.
    ratio = -a / F.nullif(d, zero)
    det = F.nullif(a * e - b * d, zero)
    py = F.coalesce((-(ratio * f) - c + ratio * y + x) / F.nullif(b + ratio * e, zero), (a * (y - f) - d * (x - c)) / det)
    px = F.coalesce((-b * py - c + x) / F.nullif(a, zero), ((x - c) * e - (y - f) * b) / det)
    if mirrored:
        px, py = F.col("width") - px, F.col("height") - py
    return F.rint(px).cast("long"), F.rint(py).cast("long")
