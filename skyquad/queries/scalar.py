"""Scalar functions over the fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import with_sql
from ..functions import angles, plate, ratios, sphere
from ..operators import annotate, cells, fit, index
from .base import Registry, dist, fixture, plane_x, plane_y, r6, sql_r6

REGISTRY = Registry()
S = REGISTRY.scalar
_SEX = {"h": "CAST(star_id % 24 AS DOUBLE)", "m": "CAST((star_id*7) % 60 AS DOUBLE)", "s": "CAST((star_id*13) % 6000 AS DOUBLE)/1e2"}
_TEXT = {"raw": "concat(CAST(star_id % 24 AS VARCHAR(9)), ' ', CAST((star_id*7) % 60 AS VARCHAR(9)), ' ', CAST((star_id*13) % 60 AS VARCHAR(9)))", "h": "CAST(star_id % 24 AS DOUBLE)", "m": "CAST((star_id*7) % 60 AS DOUBLE)", "s": "CAST((star_id*13) % 60 AS DOUBLE)", "neg": "star_id % 2 = 0"}
_DEC = _TEXT | {"raw": f"concat(CASE WHEN star_id % 2 = 0 THEN '-' ELSE '' END, {_TEXT['raw'][7:]}"}
_POS = {"ra": "ra", "dec": "dec"}
_PAIR = _POS | {"ra2": "CAST((star_id*7919) % 36000 AS DOUBLE)/1e2", "dec2": "CAST((star_id*104729) % 18001 - 9000 AS DOUBLE)/1e2"}

S("fn_01_degrees_radians", "sky_stars", _POS, {"rad": (lambda: r6(F.radians("ra")), sql_r6("radians(ra)")), "deg": (lambda: r6(F.degrees(F.radians("dec"))), sql_r6("degrees(radians(dec))"))})
S("fn_02_hms_to_degrees", "sky_stars", _SEX, {"deg": (lambda: r6(angles.hms_to_degrees("h", "m", "s")), sql_r6("15e0*(h + m/60e0 + s/3600e0)"))})
S("fn_03_ra_text_to_degrees", "sky_stars", _TEXT, {"deg": (lambda: r6(angles.ra_text_to_degrees("raw")), sql_r6("15e0*(h + m/60e0 + s/3600e0)"))})
S("fn_04_dms_to_degrees", "sky_stars", _TEXT, {"deg": (lambda: r6(angles.dms_to_degrees("neg", "h", "m", "s")), sql_r6("(CASE WHEN neg THEN -1e0 ELSE 1e0 END)*(h + m/60e0 + s/3600e0)"))})
S("fn_05_dec_text_to_degrees", "sky_stars", _DEC, {"deg": (lambda: r6(angles.dec_text_to_degrees("raw")), sql_r6("(CASE WHEN neg THEN -1e0 ELSE 1e0 END)*(h + m/60e0 + s/3600e0)"))})


def _sexagesimal(v: str) -> str:
    minutes = f"(({v}) - floor({v}))*60e0"
    seconds = f"({minutes} - floor({minutes}))*60e0"
    return f"CAST(floor({v}) AS BIGINT) || ' ' || CAST(floor({minutes}) AS BIGINT) || ' ' || regexp_replace(printf('%.2f', round({seconds}, 2)), '\\.?0+$', '')"


_RA_TEXT, _DEC_TEXT = _sexagesimal("(ra/15e0)"), f"(CASE WHEN dec < 0 THEN '-' ELSE '' END) || {_sexagesimal('abs(dec)')}"
S("fn_07_dec_text", "sky_stars", _POS, {"txt": (lambda: angles.dec_text("dec"), _DEC_TEXT)})
S("fn_08_ra_text", "sky_stars", _POS, {"txt": (lambda: angles.ra_text("ra"), _RA_TEXT)})
S("fn_09_position_texts", "sky_stars", _POS, {"txt": (lambda: F.array_join(angles.position_texts("ra", "dec"), "|"), f"({_RA_TEXT}) || '|' || {_DEC_TEXT}")})
S("fn_10_julian_epoch", "sky_stars", {"jd": "2451545e0 + CAST(star_id % 40000 AS DOUBLE)"}, {"epoch": (lambda: angles.julian_epoch("jd"), "round_even((jd - 2451545e0)/365.25 + 2000e0, 1)")})
S("fn_11_positive_ra", "sky_stars", {"a": "ra*1e1 - 720e0"}, {"deg": (lambda: r6(angles.positive_ra("a")), sql_r6("CASE WHEN a < 0 THEN ((a % 360e0) + 360e0) % 360e0 ELSE a END"))})
S("fn_12_angular_distance", "sky_stars", _PAIR, {"deg": (lambda: r6(sphere.angular_distance("ra", "dec", "ra2", "dec2")), sql_r6(dist("ra", "dec", "ra2", "dec2")))})
S("fn_13_sky_to_plane", "sky_stars", _POS, {"x": (lambda: r6(sphere.to_plane("ra", "dec", F.lit(18e0), F.lit(0.5))[0]), sql_r6(plane_x("ra", "dec", "18e0", "0.5e0"))), "y": (lambda: r6(sphere.to_plane("ra", "dec", F.lit(18e0), F.lit(0.5))[1]), sql_r6(plane_y("ra", "dec", "18e0", "0.5e0")))})
_XY = {"px": "-(ra - 18e0)/1e2", "py": "dec/1e2"}
S(
    "fn_14_plane_to_sky", "sky_stars", _XY,
    {
        "ra_back": (lambda: r6(sphere.from_plane(F.lit(18e0), F.lit(0.5), "px", "py")[0]), sql_r6("degrees(radians(18e0) + atan2(-px, cos(radians(0.5e0)) - py*sin(radians(0.5e0))))")),
        "dec_back": (lambda: r6(sphere.from_plane(F.lit(18e0), F.lit(0.5), "px", "py")[1]), sql_r6("degrees(asin((sin(radians(0.5e0)) + py*cos(radians(0.5e0)))/sqrt(1e0 + px*px + py*py)))")),
    },
)


def _precession_sql() -> dict[str, str]:
    """For 1950 to 2000: T = -0.5, t = 0.5 Julian centuries."""
    big, small = -0.5, 0.5
    arc = {}
    for name, (p, q, s) in {"zeta": ((2306.2181, 1.39656, -0.000139), (0.30188, -0.000344), 0.017998), "z": ((2306.2181, 1.39656, -0.000139), (1.09468, 0.000066), 0.018203), "theta": ((2004.3109, -0.85330, -0.000217), (-0.42665, -0.000217), -0.041833)}.items():
        seconds = (p[0] + p[1] * big + p[2] * big**2) * small + (q[0] + q[1] * big) * small**2 + s * small**3
        arc[name] = f"radians(CAST({seconds / 3600!r} AS DOUBLE))"
    a = f"(radians(ra) + {arc['zeta']})"
    east = f"sin({a})*cos(radians(dec))"
    north = f"(cos({a})*cos({arc['theta']})*cos(radians(dec)) - sin({arc['theta']})*sin(radians(dec)))"
    up = f"(cos({a})*sin({arc['theta']})*cos(radians(dec)) + cos({arc['theta']})*sin(radians(dec)))"
    return {"ra": f"degrees(atan2({east}, {north}) + {arc['z']})", "dec": f"degrees(asin({up}))"}


_PREC = _precession_sql()
S(
    "fn_15_precession", "sky_stars", _POS,
    {
        "ra2000": (lambda: r6(sphere.precess("ra", "dec", F.lit(1950e0), F.lit(2000e0))[0]), sql_r6(f"CASE WHEN {_PREC['ra']} < 0 THEN {_PREC['ra']} + 360e0 ELSE {_PREC['ra']} END")),
        "dec2000": (lambda: r6(sphere.precess("ra", "dec", F.lit(1950e0), F.lit(2000e0))[1]), sql_r6(_PREC["dec"])),
    },
)


def _view(i: int):
    return lambda: r6(sphere.project_to_view("ra", "dec", F.lit(18e0), F.lit(0.5), F.lit(30e0), F.lit(1600), F.lit(1200), F.lit(3.8), F.lit(2), F.lit(135e0))[i])


_PER = {n: f"({n}/(2e0*atan(3.8e0*2e0*{n}/1e3/(2e0*135e0))))" for n in ("1600e0", "1200e0")}
_PX, _PY = plane_x("ra", "dec", "18e0", "0.5e0"), plane_y("ra", "dec", "18e0", "0.5e0")
S(
    "fn_16_project_to_view", "sky_stars", _POS,
    {
        "x": (_view(0), sql_r6(f"1600e0 - ({_PER['1600e0']}*cos(radians(-30e0))*{_PX} + {_PER['1200e0']}*sin(radians(-30e0))*{_PY} + 800e0)")),
        "y": (_view(1), sql_r6(f"-{_PER['1600e0']}*sin(radians(-30e0))*{_PX} + {_PER['1200e0']}*cos(radians(-30e0))*{_PY} + 600e0")),
    },
)
S(
    "fn_17_texts_to_position", "sky_stars", _DEC | {"raw2": _TEXT["raw"]},
    {
        "ra_deg": (lambda: r6(angles.ra_text_to_degrees("raw2")), sql_r6("15e0*(h + m/60e0 + s/3600e0)")),
        "dec_deg": (lambda: r6(angles.dec_text_to_degrees("raw")), sql_r6("(CASE WHEN neg THEN -1e0 ELSE 1e0 END)*(h + m/60e0 + s/3600e0)")),
    },
)
_SHORT = lambda v: f"regexp_replace(printf('%.3f', round_even({v}, 3)), '\\.?0+$', '')"
S("fn_18_position_label", "sky_stars", {"ra": "ra + 3e-4", "dec": "dec + 3e-4"}, {"txt": (lambda: angles.position_label("ra", "dec", 3), f"'[' || {_SHORT('ra')} || ', ' || {_SHORT('dec')} || ']'")})
S("fn_19_pixel_distance", "image_stars", {"x": "x", "y": "y"}, {"d": (lambda: r6(plate.pixel_distance("x", "y", F.lit(800), F.lit(600))), sql_r6("sqrt((x-800)*(x-800) + (y-600)*(y-600))"))})
S("fn_20_angle_difference", "sky_stars", _PAIR, {"d": (lambda: r6(angles.angle_difference("ra", "ra2")), sql_r6("least(abs(ra - ra2) % 360e0, 360e0 - abs(ra - ra2) % 360e0)"))})
S("fn_21_cell_names", "sky_stars", {"b": "CAST(star_id % 18 AS INT)", "c": "CAST(star_id % 36 AS INT)"}, {"cell_id": (lambda: cells.cell_id("b", "c"), "printf('b%02dc%02d', b, c)"), "cell_num": (lambda: F.col("b") * 1000 + F.col("c"), "b*1000 + c")})
_RATIOS = {f"r{i}": f"CAST(CAST(((star_id + {i}) * 7919 * {i + 3}) % 100000 AS DOUBLE)/1e5 AS FLOAT)" for i in range(5)}
_TOPS = (1023, 1023, 1023, 511, 511)
_SHIFTS = (0, 10, 20, 30, 39)
_PACKED = " + ".join(f"CAST(round(CAST(r{i} AS DOUBLE)*{t}e0) AS BIGINT) * {1 << s}" for i, (t, s) in enumerate(zip(_TOPS, _SHIFTS, strict=True)))
S(
    "fn_23_pack_ratios", "sky_stars", _RATIOS,
    {"packed": (lambda: ratios.pack([F.col(f"r{i}") for i in range(5)]), _PACKED)}
    | {
        f"u{i}": (
            (lambda i=i: r6(ratios.unpack(ratios.pack([F.col(f"r{j}") for j in range(5)]))[i].cast("double"))),
            sql_r6(f"CAST(CAST(CAST(round(CAST(r{i} AS DOUBLE)*{t}e0) AS FLOAT) * CAST(1e0/{t}e0 AS FLOAT) AS FLOAT) AS DOUBLE)"),
        )
        for i, t in enumerate(_TOPS)
    },
)
S("fn_24_scale_ratios", "sky_stars", _RATIOS, {f"s{i}": ((lambda i=i: r6(ratios.scaled(f"r{i}", 0.989).cast("double"))), sql_r6(f"CAST(r{i} * CAST(0.989e0 AS FLOAT) AS DOUBLE)")) for i in range(5)})
S("fn_25_scale_ratio", "sky_stars", {"p": "CAST(ra*1e2 + 1e0 AS FLOAT)", "q": "CAST(mag AS FLOAT)"}, {"sr": (lambda: F.round(ratios.scale_ratio("p", "q"), 4), "round(CAST(CAST(CAST(p AS DOUBLE)/CAST(q AS DOUBLE) AS FLOAT) AS DOUBLE), 4)")})
S("fn_26_quad_density", "search_centers", {"n": "run_id % 1000 + 5", "radius": "radius"}, {"per_degree": (lambda: plate.quads_per_square_degree("n", "radius", F.lit(1600), F.lit(1200)), "CAST(floor(n/((2e0*radius*sin(atan(1200e0/1600e0)))*(2e0*radius*cos(atan(1200e0/1600e0))))) AS BIGINT)")}, "run_id")
S("fn_31_sigma_factor", "sky_stars", {"m": "mag*1e2"}, {"factor": (lambda: r6(fit.sigma_factor(F.col("m"))), sql_r6("CASE WHEN m <= 300 THEN 0.66e0 WHEN m >= 1500 THEN 2e0 ELSE (1e0 - (m - 300)/1200e0)*0.66e0 + (m - 300)/1200e0*2e0 END"))})
S("fn_33_view_diameter", "search_centers", {"w": "radius", "h": "abs(dec)"}, {"diameter": (lambda: r6(plate.view_diameter("w", "h")), sql_r6("sqrt(w*w + h*h)"))}, "run_id")
S("fn_34_field_radius", "search_centers", {"scale": "radius"}, {"field_radius": (lambda: r6(plate.field_radius("scale", F.lit(1600), F.lit(1200))), sql_r6("sqrt(1600e0*1600e0 + 1200e0*1200e0)*0.5e0*scale/3600e0"))}, "run_id")
S("fn_41_luminance", "sky_stars", {"r": "ra/36e0", "g": "(dec + 18e0)/36e0", "b": "mag/17e0"}, {"level": (lambda: annotate.luminance_level("r", "g", "b"), "CAST(round_even((r*0.2126e0 + g*0.7152e0 + b*0.0722e0)*255e0, 0) AS INTEGER)")})
S("fn_43_divisions", "sky_stars", {"n": "CAST(star_id AS DOUBLE)*9e0"}, {"d": (lambda: index.divisions(F.col("n")), "CAST(floor(least(greatest(n/2e3, 2e0), 12e0)) AS INTEGER)")})
_LINE = {"x1": "ra", "y1": "dec", "x2": "mag", "y2": "ra + mag"}


def _crossing(i: int):
    pt = lambda *v: tuple(F.col(c) if isinstance(c, str) else F.lit(c) for c in v)
    return lambda: r6(annotate.line_intersection(pt("x1", "y1"), pt("x2", "y2"), pt(0e0, 5e0), pt(100e0, 7e0))[i])


_A1, _B1 = "(y2 - y1)", "(x1 - x2)"
_C1, _C2, _DELTA = f"({_A1}*x1 + {_B1}*y1)", "(2e0*0e0 + -100e0*5e0)", f"nullif({_A1}*-100e0 - 2e0*{_B1}, 0e0)"
S("fn_36_line_intersection", "sky_stars", _LINE, {"x": (_crossing(0), sql_r6(f"(-100e0*{_C1} - {_B1}*{_C2})/{_DELTA}")), "y": (_crossing(1), sql_r6(f"({_A1}*{_C2} - 2e0*{_C1})/{_DELTA}"))})
S(
    "fn_37_grid_interval", "search_centers", {"r": "radius*radius/2e0", "pole": "run_id % 7 = 0"},
    {
        "ra_step": (lambda: annotate.grid_interval("r", "pole")[0], "CASE WHEN pole THEN 30e0 WHEN r > 10 THEN 15e0 WHEN r > 5 THEN 5e0 WHEN r > 2 THEN 2e0 WHEN r > 1 THEN 1e0 WHEN r > 0.5 THEN 0.5e0 ELSE 0.25e0 END"),
        "dec_step": (lambda: annotate.grid_interval("r", "pole")[1], "CASE WHEN pole THEN 0.5e0 WHEN r > 10 THEN 10e0 WHEN r > 5 THEN 5e0 WHEN r > 2 THEN 2e0 WHEN r > 1 THEN 1e0 WHEN r > 0.5 THEN 0.5e0 ELSE 0.25e0 END"),
    },
    "run_id",
)
S("agg_22_centroid_inputs", "sky_stars", _POS, {n: ((lambda i=i: r6(sphere.unit_vector("ra", "dec")[i])), sql_r6(e)) for i, (n, e) in enumerate({"vx": "cos(radians(dec))*cos(radians(ra))", "vy": "cos(radians(dec))*sin(radians(ra))", "vz": "sin(radians(dec))"}.items())})


@REGISTRY.add("fn_06_julian_days", """
    SELECT event_id, round(epoch(ts)/86400e0 + 2440587.5e0, 6) AS jd, floor(epoch(ts)/86400e0) + 2440587.5e0 AS jd_day
    FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events) t""")
def fn_06(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", F.round(angles.julian_days("ts"), 6).alias("jd"), angles.julian_day_number("ts").alias("jd_day"))


@REGISTRY.add("agg_22_spherical_centroid", with_sql("sky_stars") + f"""
    SELECT band, round(degrees(atan2(y, x)), 6) + 0e0 AS ra, round(degrees(atan2(z, sqrt(x*x + y*y))), 6) + 0e0 AS dec
    FROM (SELECT CAST(star_id % 7 AS BIGINT) AS band, avg(cos(radians(dec))*cos(radians(ra))) AS x, avg(cos(radians(dec))*sin(radians(ra))) AS y, avg(sin(radians(dec))) AS z
          FROM sky_stars GROUP BY 1) t""")
def agg_22(spark, sf_dir):
    ra, dec = sphere.centroid("ra", "dec")
    stars = fixture(spark, sf_dir, "sky_stars")
    return stars.groupBy((F.col("star_id") % 7).alias("band")).agg(r6(ra).alias("ra"), r6(dec).alias("dec"))
