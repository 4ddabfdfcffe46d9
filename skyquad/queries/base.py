"""Registration of queries, and SQL snippets of the geometry for the second engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import fixture, with_sql


@dataclass
class Registry:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None):
        """Decorator: registers a query under ``name``, with its SQL if there is one."""

        def register(f):
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return register

    def scalar(self, name: str, source: str, inputs: dict[str, str], outputs: dict[str, tuple[Callable[[], Column], str]], key: str = "star_id") -> None:
        """A function over every row of a fixture. ``inputs`` are expressions of both engines;
        ``outputs`` give the column, and the SQL that must agree with it."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fixture(spark, sf_dir, source).selectExpr(key, *[f"{e} AS {n}" for n, e in inputs.items()])
            return df.select(key, *[c().alias(n) for n, (c, _) in outputs.items()])

        given = ", ".join([key] + [f"{e} AS {n}" for n, e in inputs.items()])
        wanted = ", ".join([key] + [f"{sql} AS {n}" for n, (_, sql) in outputs.items()])
        self.add(name, f"{with_sql(source)} SELECT {wanted} FROM (SELECT {given} FROM {source}) t")(run)


def r6(value: Column) -> Column:
    """Six decimals; adding zero makes -0 a plain 0."""
    return F.round(value, 6) + F.lit(0e0)


def sql_r6(value: str) -> str:
    return f"round({value}, 6) + 0e0"


def dist(ra1: str, dec1: str, ra2: str, dec2: str) -> str:
    """Angular distance in SQL."""
    cosine = f"sin(radians({dec1}))*sin(radians({dec2})) + cos(radians({dec1}))*cos(radians({dec2}))*cos(radians({ra1}) - radians({ra2}))"
    return f"(CASE WHEN {ra1} = {ra2} AND {dec1} = {dec2} THEN 0e0 ELSE degrees(acos(greatest(-1e0, least(1e0, {cosine})))) END)"


def plane_x(ra: str, dec: str, ra0: str, dec0: str) -> str:
    return f"(cos(radians({dec}))*sin(radians({ra}) - radians({ra0})) / ({_below(ra, dec, ra0, dec0)}))"


def plane_y(ra: str, dec: str, ra0: str, dec0: str) -> str:
    return (
        f"((sin(radians({dec0}))*cos(radians({dec}))*cos(radians({ra}) - radians({ra0})) - cos(radians({dec0}))*sin(radians({dec})))"
        f" / ({_below(ra, dec, ra0, dec0)}))"
    )


def _below(ra: str, dec: str, ra0: str, dec0: str) -> str:
    return f"cos(radians({dec0}))*cos(radians({dec}))*cos(radians({ra}) - radians({ra0})) + sin(radians({dec0}))*sin(radians({dec}))"


def band_sql(dec: str) -> str:
    from ..operators.cells import BANDS

    return "CASE " + " ".join(f"WHEN {dec} > {bottom!r} THEN {band}" for band, bottom, _, _ in BANDS[:-1]) + f" ELSE {BANDS[-1][0]} END"


def cells_cte() -> str:
    """``cells``: the 406 cells."""
    from ..operators.cells import BANDS

    rows = ", ".join(f"({band}, CAST({bottom!r} AS DOUBLE), CAST({top!r} AS DOUBLE), {w})" for band, bottom, top, w in BANDS)
    return (
        f"bands(band, dec_bottom, dec_top, w) AS (VALUES {rows}), cells AS (SELECT band, CAST(k AS INTEGER) AS cell, printf('b%02dc%02d', band, k) AS cell_id, "
        "CAST(k * w AS DOUBLE) AS ra_left, CAST(k * w + w AS DOUBLE) AS ra_right, dec_bottom, dec_top FROM bands, LATERAL (SELECT unnest(range(CAST(360 // w AS BIGINT))) AS k) u)"
    )


def circle_sql(radius: str, ra: str, dec: str) -> str:
    """Circle meets cell (columns of ``cells``)."""
    turn = lambda edge: f"(CASE WHEN abs({ra} - {edge}) % 360 > 180 THEN 360 - abs({ra} - {edge}) % 360 ELSE abs({ra} - {edge}) % 360 END)"
    near_dec = (
        f"(CASE WHEN {dec} + {radius} >= 90 AND dec_top = 90 THEN 90e0 WHEN {dec} - {radius} <= -90 AND dec_bottom = -90 THEN -90e0 "
        f"ELSE greatest(dec_bottom, least({dec}, dec_top)) END)"
    )
    near_ra = f"(CASE WHEN {ra} > ra_left AND {ra} < ra_right THEN {ra} WHEN {turn('ra_left')} < {turn('ra_right')} THEN ra_left ELSE ra_right END)"
    return f"NOT (dec_top < {dec} - {radius} OR dec_bottom > {dec} + {radius}) AND (({near_ra} = {ra} AND {near_dec} = {dec}) OR {radius} - {dist(ra, dec, near_ra, near_dec)} > 0)"
