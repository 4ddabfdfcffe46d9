"""Geometry on the sky: distances, tangent-plane projections, precession, centroids. Degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import positive_ra
from .base import Value, col

#: IAU 1976 precession polynomials, arc seconds, in (T, t) powers.
_ZETA = ((2306.2181, 1.39656, -0.000139), (0.30188, -0.000344), 0.017998)
_Z = ((2306.2181, 1.39656, -0.000139), (1.09468, 0.000066), 0.018203)
_THETA = ((2004.3109, -0.85330, -0.000217), (-0.42665, -0.000217), -0.041833)
J2000 = 2451545.0


def angular_distance(ra1: Value, dec1: Value, ra2: Value, dec2: Value) -> Column:
    """Great-circle distance. The cosine is clamped, so that rounding gives no NaN, and equal
    coordinates are exactly 0 apart."""
    ra1, dec1, ra2, dec2 = map(col, (ra1, dec1, ra2, dec2))
    d1, d2 = F.radians(dec1), F.radians(dec2)
    cosine = F.sin(d1) * F.sin(d2) + F.cos(d1) * F.cos(d2) * F.cos(F.radians(ra1) - F.radians(ra2))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1e0), F.least(F.lit(1e0), cosine))))
    return F.when((ra1 == ra2) & (dec1 == dec2), F.lit(0e0)).otherwise(angle)


def to_plane(ra: Value, dec: Value, center_ra: Value, center_dec: Value) -> tuple[Column, Column]:
    """Standard coordinates (gnomonic, y negated) around a center."""
    r, d = F.radians(col(ra)) - F.radians(col(center_ra)), F.radians(col(dec))
    c = F.radians(col(center_dec))
    below = F.cos(c) * F.cos(d) * F.cos(r) + F.sin(c) * F.sin(d)
    return F.cos(d) * F.sin(r) / below, (F.sin(c) * F.cos(d) * F.cos(r) - F.cos(c) * F.sin(d)) / below


def from_plane(center_ra: Value, center_dec: Value, x: Value, y: Value, wrap: bool = True) -> tuple[Column, Column]:
    """Sky position of *negated* standard coordinates, as plate constants give them."""
    r, d, x, y = F.radians(col(center_ra)), F.radians(col(center_dec)), col(x), col(y)
    ra = r + F.atan2(-x, F.cos(d) - y * F.sin(d))
    dec = F.asin((F.sin(d) + y * F.cos(d)) / F.sqrt(F.lit(1e0) + x * x + y * y))
    return positive_ra(F.degrees(ra)) if wrap else F.degrees(ra), F.degrees(dec)


def _polynomial(terms: tuple, a: Column, b: Column) -> Column:
    (p0, p1, p2), (q0, q1), s = terms
    return (F.lit(p0) + a * p1 + a * a * p2) * b + (F.lit(q0) + a * q1) * (b * b) + b * b * b * s


def precess(ra: Value, dec: Value, source: Value, target: Value) -> tuple[Column, Column]:
    """From one Julian epoch to another."""
    a = (col(source) - 2000e0) * 365.25 / 36525e0
    b = (col(target) - col(source)) * 365.25 / 36525e0
    zeta, z, theta = (F.radians(_polynomial(p, a, b) / 3600e0) for p in (_ZETA, _Z, _THETA))
    r, d = F.radians(col(ra)) + zeta, F.radians(col(dec))
    east = F.sin(r) * F.cos(d)
    north = F.cos(r) * F.cos(theta) * F.cos(d) - F.sin(theta) * F.sin(d)
    up = F.cos(r) * F.sin(theta) * F.cos(d) + F.cos(theta) * F.sin(d)
    return positive_ra(F.degrees(F.atan2(east, north) + z)), F.degrees(F.asin(up))


def project_to_view(
    ra: Value, dec: Value, center_ra: Value, center_dec: Value, rotation: Value,
    width: Value, height: Value, pixel_microns: Value, binning: Value, focal_mm: Value,
) -> tuple[Column, Column]:
    """Pixel position in a simulated camera view; x is mirrored."""
    x, y = to_plane(ra, dec, center_ra, center_dec)
    width, height = col(width).cast("double"), col(height).cast("double")

    def per_radian(pixels: Column) -> Column:
        return pixels / (F.atan(col(pixel_microns) * col(binning) * pixels / 1000e0 / (col(focal_mm) * 2e0)) * 2e0)

    turn = F.radians(-col(rotation))
    px = per_radian(width) * F.cos(turn) * x + per_radian(height) * F.sin(turn) * y + width / 2e0
    py = -per_radian(width) * F.sin(turn) * x + per_radian(height) * F.cos(turn) * y + height / 2e0
    return width - px, py


def unit_vector(ra: Value, dec: Value) -> tuple[Column, Column, Column]:
    r, d = F.radians(col(ra)), F.radians(col(dec))
    return F.cos(d) * F.cos(r), F.cos(d) * F.sin(r), F.sin(d)


def vector_position(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """RA and Dec of a vector of any length."""
    return positive_ra(F.degrees(F.atan2(y, x))), F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def centroid(ra: Value, dec: Value) -> tuple[Column, Column]:
    """Aggregates: RA and Dec of the mean unit vector of a group."""
    return vector_position(*[F.avg(v) for v in unit_vector(ra, dec)])
