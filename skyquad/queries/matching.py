"""Picture quads, ratio joins, index lookup, robust fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import HEIGHT, WIDTH, pictures, with_sql
from ..operators import annotate, bandjoin, fit, lookup, match, quads
from ..plans import solve
from .base import Registry, circle_sql, dist, fixture, plane_x, plane_y, r6
from .catalog import _DOUBLES, _PAIRS, as_doubles, fixture_index, index_ctes

REGISTRY = Registry()
A = REGISTRY.add
NAMES = ["r0", "r1", "r2", "r3", "r4"]


def _brightest_ctes(prefix: str) -> str:
    return prefix + """,
    sizes AS (SELECT image_id, size, row_number() OVER (PARTITION BY image_id ORDER BY size, star_id) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM image_stars),
    medians AS (SELECT image_id, max(n) AS n, avg(size) AS median_size FROM sizes WHERE CASE WHEN n % 2 = 1 THEN i = n//2 WHEN n = 2 THEN true ELSE i IN (n//2, n//2 + 1) END GROUP BY image_id),
    adjusted AS (SELECT s.*, m.n, CASE WHEN size <= median_size THEN CAST(brightness AS DOUBLE) ELSE brightness + size/median_size*50e0 END AS adjusted FROM image_stars s JOIN medians m ON m.image_id = s.image_id),
    top_stars AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY adjusted DESC, star_id) AS rank FROM adjusted
             QUALIFY rank <= CASE WHEN n*0.33e0 <= 300 THEN 300 ELSE floor(least(n*0.33e0, 1000)) END)"""


def _picture_ctes(prefix: str) -> str:
    at = lambda k, c: "s." + c if k == 0 else f"n{k}.{c}"
    sides = ", ".join(f"sqrt(({at(i, 'x')} - {at(j, 'x')})*({at(i, 'x')} - {at(j, 'x')}) + ({at(i, 'y')} - {at(j, 'y')})*({at(i, 'y')} - {at(j, 'y')}))" for i, j in _PAIRS)
    mean = lambda c: "(" + " + ".join(at(k, c) for k in range(4)) + ")/4e0"
    return _brightest_ctes(prefix) + f""",
    in_pass AS (SELECT t.*, p FROM (SELECT *, count(*) OVER (PARTITION BY image_id) AS m FROM top_stars) t, (SELECT unnest(range(4)) AS p) u WHERE rank <= floor(m*(1e0 - p*0.05e0))),
    i_pairs AS (SELECT a.image_id, a.p, a.star_id, a.rank, b.star_id AS other, b.rank AS other_rank, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS apart
                FROM in_pass a JOIN in_pass b ON a.image_id = b.image_id AND a.p = b.p AND a.star_id <> b.star_id),
    i_near AS (SELECT *, row_number() OVER (PARTITION BY image_id, p, star_id ORDER BY apart, other_rank) AS place FROM i_pairs WHERE apart > 0 QUALIFY place <= 3),
    i_threes AS (SELECT image_id, p, star_id, rank, max(other) FILTER (place = 1) AS o1, max(other) FILTER (place = 2) AS o2, max(other) FILTER (place = 3) AS o3 FROM i_near GROUP BY ALL HAVING count(*) = 3),
    i_fours AS (SELECT t.image_id, t.p, t.rank, list_sort([t.star_id, o1, o2, o3]) AS star_set, list_sort([{sides}]) AS l, {mean('x')} AS mid_x, {mean('y')} AS mid_y
                FROM i_threes t JOIN top_stars s ON s.image_id = t.image_id AND s.star_id = t.star_id JOIN top_stars n1 ON n1.image_id = t.image_id AND n1.star_id = o1
                JOIN top_stars n2 ON n2.image_id = t.image_id AND n2.star_id = o2 JOIN top_stars n3 ON n3.image_id = t.image_id AND n3.star_id = o3),
    i_once AS (SELECT * FROM i_fours QUALIFY row_number() OVER (PARTITION BY image_id, star_set ORDER BY p, rank) = 1),
    image_quads AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY CAST(l[1]/l[6] AS FLOAT), p, rank) - 1 AS quad_id, CAST(p AS INTEGER) AS pass,
                    {", ".join(f"CAST(l[{i + 1}]/l[6] AS FLOAT) AS r{i}" for i in range(5))}, CAST(l[6] AS FLOAT) AS largest, mid_x, mid_y, array_to_string(star_set, ',') AS star_set,
                    count(*) FILTER (p = 0) OVER (PARTITION BY image_id) AS n_first FROM i_once)"""


_LOW, _HIGH = "(CAST(1 AS FLOAT) - CAST(0.011e0 AS FLOAT))", "(CAST(1 AS FLOAT) + CAST(0.011e0 AS FLOAT))"
_WITHIN = " AND ".join(f"i.r{k} >= CAST(q.r{k}*{_LOW} AS FLOAT) AND i.r{k} <= CAST(q.r{k}*{_HIGH} AS FLOAT)" for k in range(5))
_AGREES = " AND ".join(f"abs(CAST(CAST(i.r{k} AS DOUBLE)/CAST(q.r{k} AS DOUBLE) AS FLOAT)::DOUBLE - 1e0) <= 0.011e0" for k in range(5))


def _pairs_ctes() -> str:
    """... candidates (from the whole index) after index and picture tables."""
    return _picture_ctes(index_ctes() + f", {_only('image_stars')}") + f""",
    candidates AS (SELECT i.image_id, i.quad_id, q.*, i.largest AS i_largest, ({_WITHIN}) AS is_within, ({_AGREES}) AS is_match
                   FROM image_quads i JOIN quads q ON q.r0 > 0 AND i.r0 > 0 AND q.r0 BETWEEN i.r0*0.98e0 AND i.r0*1.02e0 AND (({_WITHIN}) OR ({_AGREES})))"""


def _only(name: str) -> str:
    from ..fixtures import DUCKDB

    return f"{name} AS ({DUCKDB[name]})"


_RUNS = [(0, 17.6, 0.9, 5.7), (1, 20.0, -2.0, 4.0), (2, 9.0, 8.0, 6.0), (3, 18.0, 0.5, 5.0)]
_RUNS_CTE = "my_runs(run_id, s_ra, s_dec, s_radius) AS (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), {a}e0, {b}e0, {c}e0)" for i, a, b, c in _RUNS) + ")"


def _area_ctes() -> str:
    near = dist("CAST(center_ra AS DOUBLE)", "CAST(center_dec AS DOUBLE)", "s_ra", "s_dec")
    return _pairs_ctes() + f""", {_RUNS_CTE},
    dens AS (SELECT r.*, i.image_id, CAST(floor(n_first/((2e0*s_radius*sin(atan({HEIGHT}e0/{WIDTH}e0)))*(2e0*s_radius*cos(atan({HEIGHT}e0/{WIDTH}e0))))) AS BIGINT) AS per_degree
             FROM my_runs r, (SELECT DISTINCT image_id, n_first FROM image_quads) i),
    run_cells AS (SELECT d.*, cell_id FROM dens d, cells WHERE {circle_sql('s_radius', 's_ra', 's_dec')}),
    nearest AS (SELECT r.*, p.density_rank AS at FROM run_cells r JOIN index_pass p ON p.cell_id = r.cell_id
                QUALIFY row_number() OVER (PARTITION BY r.image_id, r.run_id, r.cell_id ORDER BY abs(CAST(p.density AS DOUBLE) - per_degree), p.density_rank) = 1),
    run_passes AS (SELECT n.*, CAST(o + 1 AS INTEGER) AS offset_pos, p.pass, p.avg_subcell_radius FROM nearest n, (SELECT unnest([-1, 0, 1]) AS o) u, index_pass p WHERE p.cell_id = n.cell_id AND p.density_rank = n.at + o),
    run_subcells AS (SELECT r.*, s.subcell, s.n_quads FROM run_passes r JOIN index_subcell s ON s.cell_id = r.cell_id AND s.pass = r.pass
                     WHERE abs(CAST(center_dec AS DOUBLE) - s_dec) < s_radius + avg_subcell_radius AND {near} < s_radius + avg_subcell_radius)"""


_MID = dist("CAST(c.mid_ra AS DOUBLE)", "CAST(c.mid_dec AS DOUBLE)", "s_ra", "s_dec")


def _found_ctes() -> str:
    return _area_ctes() + f""",
    found AS (SELECT c.*, r.run_id, r.offset_pos FROM candidates c JOIN run_subcells r ON r.image_id = c.image_id AND r.cell_id = c.cell_id AND r.pass = c.pass AND r.subcell = c.subcell WHERE {_MID} < s_radius),
    firsts AS (SELECT *, max(CAST(is_within AS INTEGER)) OVER w AS hit, rank() OVER (PARTITION BY image_id, run_id, r0, r1, r2, r3, r4, largest ORDER BY offset_pos, cell_id, pass, subcell, pos) AS place
               FROM found WINDOW w AS (PARTITION BY image_id, run_id, r0, r1, r2, r3, r4, largest)),
    potential AS (SELECT * FROM firsts WHERE hit = 1 AND place = 1)"""


def chosen(spark, sf_dir):
    return quads.brightest(fixture(spark, sf_dir, "image_stars"))


def search(spark, sf_dir):
    return solve.open_search(fixture(spark, sf_dir, "image_stars"), pictures(spark), fixture_index(spark, sf_dir))


def my_runs(spark):
    return spark.createDataFrame(_RUNS, "run_id long, ra double, dec double, radius double")


def runs_of_the_picture(spark):
    return my_runs(spark).withColumn("image_id", F.lit(1).cast("long"))


def run_passes(spark, sf_dir):
    built = fixture_index(spark, sf_dir)
    found = solve.open_search(fixture(spark, sf_dir, "image_stars"), pictures(spark), built)
    return lookup.runs_to_passes(solve.prepare_runs(found, runs_of_the_picture(spark)), built.passes), built, found


def potential(spark, sf_dir):
    found = search(spark, sf_dir)
    return solve.find_potential(found, solve.prepare_runs(found, runs_of_the_picture(spark)))


@A("agg_08_median_size", _brightest_ctes(with_sql("image_stars")) + " SELECT image_id, median_size FROM medians")
def agg_08(spark, sf_dir):
    return quads.median_size(fixture(spark, sf_dir, "image_stars"))


@A("top_01_brightest_stars", _brightest_ctes(with_sql("image_stars")) + " SELECT image_id, star_id, CAST(rank AS BIGINT) AS rank, round(adjusted, 6) AS adjusted FROM top_stars")
def top_01(spark, sf_dir):
    return chosen(spark, sf_dir).select("image_id", "star_id", F.col("rank").cast("long").alias("rank"), r6(F.col("adjusted")).alias("adjusted"))


@A("top_02_max_stars", with_sql("search_centers") + " SELECT run_id, CAST(CASE WHEN n*0.33e0 <= 300 THEN 300 ELSE floor(least(n*0.33e0, 1000e0)) END AS BIGINT) AS max_stars FROM (SELECT run_id, run_id*57 AS n FROM search_centers) t")
def top_02(spark, sf_dir):
    return fixture(spark, sf_dir, "search_centers").select("run_id", quads.max_stars(F.col("run_id") * 57).alias("max_stars"))


@A("win_04_prefix_passes", _picture_ctes(with_sql("image_stars")) + " SELECT image_id, CAST(p AS INTEGER) AS pass, count(*) AS n FROM in_pass GROUP BY ALL")
def win_04(spark, sf_dir):
    stars = chosen(spark, sf_dir)
    sized = stars.groupBy("image_id").agg(F.count(F.lit(1)).alias("m"))
    every = sized.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(quads.PASSES - 1))))
    return every.select("image_id", "pass", F.floor(F.col("m") * (F.lit(1e0) - F.col("pass") * 0.05)).alias("n"))


def _image_quads(spark, sf_dir):
    return quads.picture_quads(chosen(spark, sf_dir))


_IQ = ", ".join(f"round(CAST({c} AS DOUBLE), 5) + 0e0 AS {c}" for c in [*NAMES, "largest"])


@A("sol_01_picture_quads", _picture_ctes(with_sql("image_stars")) + f" SELECT image_id, quad_id, pass, {_IQ}, round(mid_x + 1e-7, 4) AS mid_x, round(mid_y + 1e-7, 4) AS mid_y, star_set FROM image_quads")
def sol_01(spark, sf_dir):
    found = _image_quads(spark, sf_dir)
    rounded = [(F.round(F.col(c).cast("double"), 5) + 0e0).alias(c) for c in [*NAMES, "largest"]]
    return found.select("image_id", "quad_id", "pass", *rounded, F.round(F.col("mid_x") + 1e-7, 4).alias("mid_x"), F.round(F.col("mid_y") + 1e-7, 4).alias("mid_y"), F.array_join(F.array_sort("star_ids"), ",").alias("star_set"))


@A("join_08_picture_neighbours", _picture_ctes(with_sql("image_stars")) + " SELECT image_id, array_to_string(star_set, ',') AS star_set, round(mid_x + 1e-7, 4) AS mid_x FROM i_once")
def join_08(spark, sf_dir):
    return _image_quads(spark, sf_dir).select("image_id", F.array_join(F.array_sort("star_ids"), ",").alias("star_set"), F.round(F.col("mid_x") + 1e-7, 4).alias("mid_x"))


@A("win_03_three_nearest", _picture_ctes(with_sql("image_stars")) + " SELECT image_id, pass, count(*) AS n FROM image_quads GROUP BY ALL")
def win_03(spark, sf_dir):
    return _image_quads(spark, sf_dir).groupBy("image_id", "pass").agg(F.count(F.lit(1)).alias("n"))


@A("agg_09_quad_ratios", _picture_ctes(with_sql("image_stars")) + f" SELECT image_id, star_set, {_IQ} FROM image_quads")
def agg_09(spark, sf_dir):
    rounded = [(F.round(F.col(c).cast("double"), 5) + 0e0).alias(c) for c in [*NAMES, "largest"]]
    return _image_quads(spark, sf_dir).select("image_id", F.array_join(F.array_sort("star_ids"), ",").alias("star_set"), *rounded)


@A("agg_10_distinct_picture_quads", _picture_ctes(with_sql("image_stars")) + " SELECT image_id, count(*) AS n_quads FROM image_quads GROUP BY ALL")
def agg_10(spark, sf_dir):
    return _image_quads(spark, sf_dir).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_quads"))


@A("agg_11_first_pass_quads", _picture_ctes(with_sql("image_stars")) + " SELECT DISTINCT image_id, n_first FROM image_quads")
def agg_11(spark, sf_dir):
    return _image_quads(spark, sf_dir).select("image_id", "n_first").distinct()


@A("set_02_all_passes", _picture_ctes(with_sql("image_stars")) + " SELECT image_id, CAST(sum(CASE WHEN pass > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_later FROM image_quads GROUP BY ALL")
def set_02(spark, sf_dir):
    return _image_quads(spark, sf_dir).groupBy("image_id").agg(F.sum((F.col("pass") > 0).cast("long")).alias("n_later"))


@A("top_04_quads_by_ratio", _picture_ctes(with_sql("image_stars")) + " SELECT image_id, quad_id, star_set FROM image_quads")
def top_04(spark, sf_dir):
    return _image_quads(spark, sf_dir).select("image_id", "quad_id", F.array_join(F.array_sort("star_ids"), ",").alias("star_set"))


_KEY = "image_id, quad_id, cell_id, pass, CAST(subcell AS INTEGER) AS subcell, pos"


@A("join_02_ratio_band_join", _pairs_ctes() + f" SELECT {_KEY}, is_within, is_match FROM candidates")
def join_02(spark, sf_dir):
    pairs = bandjoin.candidates(_image_quads(spark, sf_dir), fixture_index(spark, sf_dir).quads)
    return pairs.select("image_id", "quad_id", "cell_id", "pass", "subcell", "pos", "is_within", "is_match")


@A("flt_12_ratio_window", _pairs_ctes() + f" SELECT {_KEY} FROM candidates WHERE is_within")
def flt_12(spark, sf_dir):
    return search(spark, sf_dir).pairs.filter("is_within").select("image_id", "quad_id", "cell_id", "pass", "subcell", "pos")


@A("flt_13_ratio_agreement", _pairs_ctes() + f" SELECT {_KEY} FROM candidates WHERE is_match")
def flt_13(spark, sf_dir):
    return search(spark, sf_dir).pairs.filter("is_match").select("image_id", "quad_id", "cell_id", "pass", "subcell", "pos")


@A("join_05_nearest_density_pass", _area_ctes() + " SELECT image_id, run_id, cell_id, offset_pos, pass FROM run_passes")
def join_05(spark, sf_dir):
    return run_passes(spark, sf_dir)[0].select("image_id", "run_id", "cell_id", "offset_pos", "pass")


@A("flt_16_offsets_in_ladder", _area_ctes() + " SELECT run_id, cell_id, count(*) AS n_passes FROM run_passes GROUP BY ALL")
def flt_16(spark, sf_dir):
    return run_passes(spark, sf_dir)[0].groupBy("run_id", "cell_id").agg(F.count(F.lit(1)).alias("n_passes"))


def _near_subcells(spark, sf_dir):
    passes, built, _ = run_passes(spark, sf_dir)
    return passes.join(built.subcells, ["cell_id", "pass"]).filter(lookup.subcell_in_range())


@A("join_06_subcells_in_range", _area_ctes() + " SELECT image_id, run_id, cell_id, pass, subcell FROM run_subcells")
def join_06(spark, sf_dir):
    return _near_subcells(spark, sf_dir).select("image_id", "run_id", "cell_id", "pass", "subcell")


@A("flt_11_subcell_range", _area_ctes() + " SELECT run_id, pass, count(*) AS n_subcells, CAST(sum(n_quads) AS BIGINT) AS n_quads FROM run_subcells GROUP BY ALL")
def flt_11(spark, sf_dir):
    return _near_subcells(spark, sf_dir).groupBy("run_id", "pass").agg(F.count(F.lit(1)).alias("n_subcells"), F.sum("n_quads").alias("n_quads"))


@A("flt_10_midpoints_in_radius", _found_ctes() + f" SELECT run_id, {_KEY} FROM found")
def flt_10(spark, sf_dir):
    passes, built, found = run_passes(spark, sf_dir)
    return lookup.quads_in_area(found.pairs, built.subcells, passes).select("run_id", "image_id", "quad_id", "cell_id", "pass", "subcell", "pos")


@A("sol_05_quads_for_run", _found_ctes() + f" SELECT run_id, {_KEY}, {_DOUBLES} FROM potential")
def sol_05(spark, sf_dir):
    found = potential(spark, sf_dir)
    return found.select("run_id", "image_id", "quad_id", "cell_id", "pass", "subcell", "pos", *as_doubles(found))


@A("agg_12_distinct_quads_of_run", _found_ctes() + " SELECT run_id, cell_id, count(DISTINCT (pass, subcell, pos)) AS n_quads FROM potential GROUP BY ALL")
def agg_12(spark, sf_dir):
    return potential(spark, sf_dir).groupBy("run_id", "cell_id").agg(F.count_distinct("pass", "subcell", "pos").alias("n_quads"))


@A("agg_23_potential_counts", _found_ctes() + " SELECT image_id, run_id, count(DISTINCT (cell_id, pass, subcell, pos)) AS n_potential FROM potential GROUP BY ALL")
def agg_23(spark, sf_dir):
    return solve.count_potential(potential(spark, sf_dir))


@A("agg_24_runs_by_hits", _found_ctes() + ", counted AS (SELECT run_id, count(DISTINCT (cell_id, pass, subcell, pos)) AS n FROM potential GROUP BY ALL) SELECT r.run_id, coalesce(n, 0) AS n_potential, coalesce(n, 0) > 0 AS has_matches, row_number() OVER (ORDER BY coalesce(n, 0) DESC, r.run_id) AS place FROM my_runs r LEFT JOIN counted c ON c.run_id = r.run_id")
def agg_24(spark, sf_dir):
    counted = solve.count_potential(potential(spark, sf_dir)).select("run_id", "n_potential")
    return solve.rank_runs(my_runs(spark).select("run_id"), counted)


@A("set_01_union_of_offsets", _found_ctes() + " SELECT run_id, offset_pos, count(*) AS n FROM potential GROUP BY ALL")
def set_01(spark, sf_dir):
    return potential(spark, sf_dir).groupBy("run_id", "offset_pos").agg(F.count(F.lit(1)).alias("n"))


@A("sol_17_area_scan", _area_ctes() + f", scanned AS (SELECT r.run_id, r.offset_pos, c.* FROM quads c JOIN run_subcells r ON r.cell_id = c.cell_id AND r.pass = c.pass AND r.subcell = c.subcell WHERE {_MID} < s_radius QUALIFY row_number() OVER (PARTITION BY r.image_id, r.run_id, r0, r1, r2, r3, r4, largest ORDER BY r.offset_pos, c.cell_id, c.pass, c.subcell, c.pos) = 1) SELECT run_id, cell_id, pass, count(*) AS n FROM scanned GROUP BY ALL")
def sol_17(spark, sf_dir):
    passes, built, _ = run_passes(spark, sf_dir)
    return lookup.area_scan(built.quads, built.subcells, passes).groupBy("run_id", "cell_id", "pass").agg(F.count(F.lit(1)).alias("n"))


_CHIP = {n: f"({n}/(2e0*atan(3.8e0*2e0*{n}/1e3/(2e0*135e0))))" for n in (f"{WIDTH}e0", f"{HEIGHT}e0")}
_SEEN_X = f"{WIDTH}e0 - ({_CHIP[f'{WIDTH}e0']}*{plane_x('CAST(mid_ra AS DOUBLE)', 'CAST(mid_dec AS DOUBLE)', 's_ra', 's_dec')} + {WIDTH}e0/2)"
_SEEN_Y = f"{_CHIP[f'{HEIGHT}e0']}*{plane_y('CAST(mid_ra AS DOUBLE)', 'CAST(mid_dec AS DOUBLE)', 's_ra', 's_dec')} + {HEIGHT}e0/2"


@A("sol_17_quads_in_view", _area_ctes() + f""", scanned AS (SELECT r.run_id, s_ra, s_dec, c.* FROM quads c JOIN run_subcells r ON r.cell_id = c.cell_id AND r.pass = c.pass AND r.subcell = c.subcell WHERE {_MID} < s_radius QUALIFY row_number() OVER (PARTITION BY r.image_id, r.run_id, r0, r1, r2, r3, r4, largest ORDER BY r.offset_pos, c.cell_id, c.pass, c.subcell, c.pos) = 1),
    seen AS (SELECT *, {_SEEN_X} AS x, {_SEEN_Y} AS y FROM scanned) SELECT run_id, cell_id, pass, CAST(subcell AS INTEGER) AS subcell, pos, round(x, 3) AS x, round(y, 3) AS y FROM seen WHERE x BETWEEN 0 AND {WIDTH} AND y BETWEEN 0 AND {HEIGHT}""")
def sol_17_seen(spark, sf_dir):
    """What a camera that points at each run's center sees of the index."""
    passes, built, _ = run_passes(spark, sf_dir)
    found = lookup.quads_in_view(built.quads, built.subcells, passes, lookup.View(WIDTH, HEIGHT, 3.8, 2, 135.0))
    return found.select("run_id", "cell_id", "pass", "subcell", "pos", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@A("sol_14_quad_outlines", _picture_ctes(with_sql("image_stars")) + """, corners AS (SELECT q.image_id, q.quad_id, s.star_id, s.x, s.y, atan2(s.y - mid_y, s.x - mid_x) AS angle FROM image_quads q, LATERAL (SELECT unnest(string_split(q.star_set, ',')) AS id) u JOIN image_stars s ON s.image_id = q.image_id AND s.star_id = CAST(u.id AS BIGINT)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY image_id, quad_id ORDER BY angle, star_id) - 1 AS side FROM corners)
    SELECT a.image_id, a.quad_id, CAST(a.side AS INTEGER) AS side, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM placed a JOIN placed b ON b.image_id = a.image_id AND b.quad_id = a.quad_id AND b.side = (a.side + 1) % 4""")
def sol_14_outlines(spark, sf_dir):
    return annotate.quad_outlines(_image_quads(spark, sf_dir), fixture(spark, sf_dir, "image_stars"))


# Robust statistics over planted matches.
_M = with_sql("matches")
_GATED = _M + """,
    med AS (SELECT *, median(scale_ratio) OVER (PARTITION BY image_id, run_id) AS med, count(*) OVER (PARTITION BY image_id, run_id) AS n FROM matches),
    mad AS (SELECT *, median(abs(scale_ratio - med)) OVER (PARTITION BY image_id, run_id) AS mad FROM med),
    gated AS (SELECT * FROM mad WHERE n >= 5 AND mad <= 1.75e0)"""
_BINNED = _M + """,
    lim AS (SELECT *, min(scale_ratio) OVER w AS lo, max(scale_ratio) OVER w AS hi FROM matches WINDOW w AS (PARTITION BY image_id, run_id)),
    bins AS (SELECT *, CAST(floor((scale_ratio - lo)/((hi - lo)/10 + 1e0)) AS INTEGER) AS bin FROM lim),
    weights AS (SELECT *, count(*) OVER (PARTITION BY image_id, run_id, bin) AS weight FROM bins),
    means AS (SELECT *, sum(weight*scale_ratio) OVER (PARTITION BY image_id, run_id)/sum(weight) OVER (PARTITION BY image_id, run_id) AS mean FROM weights),
    devs AS (SELECT *, sqrt(avg((scale_ratio - mean)*(scale_ratio - mean)) OVER (PARTITION BY image_id, run_id)) AS sd FROM means),
    kept AS (SELECT *, count(*) OVER (PARTITION BY image_id, run_id) AS k FROM devs WHERE abs(scale_ratio - mean) < sd QUALIFY k >= 5)"""


def planted(spark, sf_dir):
    return fixture(spark, sf_dir, "matches")


@A("agg_18_scale_gate", _GATED + " SELECT run_id, quad_id FROM gated")
def agg_18(spark, sf_dir):
    return match.scale_gate(planted(spark, sf_dir), F.lit(1.75)).select("run_id", "quad_id")


@A("agg_19_weighted_bins", _BINNED + " SELECT run_id, quad_id FROM kept")
def agg_19(spark, sf_dir):
    return match.weighted_bins(planted(spark, sf_dir)).select("run_id", "quad_id")


@A("top_05_by_scale_ratio", _M + " SELECT run_id, round(median(scale_ratio), 6) AS middle, round(min(scale_ratio), 6) AS low, round(max(scale_ratio), 6) AS high FROM matches GROUP BY run_id")
def top_05(spark, sf_dir):
    return planted(spark, sf_dir).groupBy("run_id").agg(r6(F.median("scale_ratio")).alias("middle"), r6(F.min("scale_ratio")).alias("low"), r6(F.max("scale_ratio")).alias("high"))


_UV = _M + f", m AS (SELECT *, {plane_x('mid_ra', 'mid_dec', 'ra0', 'dec0')} AS u, {plane_y('mid_ra', 'mid_dec', 'ra0', 'dec0')} AS v FROM matches)"


def _sums(over: str, less: bool = False) -> str:
    own = {"n": "1e0", "x": "x", "y": "y", "xx": "x*x", "xy": "x*y", "yy": "y*y", "u": "u", "xu": "x*u", "yu": "y*u", "v": "v", "xv": "x*v", "yv": "y*v"}
    return ", ".join(f"sum({e}) {over}{f' - {e}' if less else ''} AS s{k}" for k, e in own.items())


def _constants() -> str:
    """a..f by Cramer's rule from s*."""
    det = lambda m: " + ".join(f"{'' if s > 0 else '-1e0*'}({m[0][i]})*(({m[1][j]})*({m[2][k]}) - ({m[1][k]})*({m[2][j]}))" for i, j, k, s in ((0, 1, 2, 1), (1, 0, 2, -1), (2, 0, 1, 1)))
    rows = [["sxx", "sxy", "sx"], ["sxy", "syy", "sy"], ["sx", "sy", "sn"]]
    out = []
    for names, w in (("abc", "u"), ("def", "v")):
        right = [f"-1e0*sx{w}", f"-1e0*sy{w}", f"-1e0*s{w}"]
        for k, name in enumerate(names):
            swapped = [[r if j == k else row[j] for j in range(3)] for row, r in zip(rows, right, strict=True)]
            out.append(f"({det(swapped)})/({det(rows)}) AS {name}")
    return ", ".join(out)


_FIT = _UV + f", totals AS (SELECT run_id, count(*) AS n_matches, {_sums('')} FROM m GROUP BY run_id), fitted AS (SELECT run_id, n_matches, {_constants()} FROM totals)"


@A("agg_17_plate_constants", _FIT + " SELECT run_id, n_matches, " + ", ".join(f"round({c}*1e{5 if c in 'abde' else 3}, 6) + 0e0 AS {c}" for c in "abcdef") + " FROM fitted")
def agg_17(spark, sf_dir):
    found = fit.fit_plates(fit.with_plane(planted(spark, sf_dir)))
    return found.select("run_id", "n_matches", *[r6(F.col(c) * (1e5 if c in "abde" else 1e3)).alias(c) for c in "abcdef"])


_SYSTEM = {"p": "ra/1e2", "q": "dec/1e2", "r": "mag/1e1", "w": "(CAST((star_id*37) % 101 AS DOUBLE) - ra)/1e2"}
_PRODUCTS = {"xx": "p*p", "xy": "p*q", "yy": "q*q", "x": "p*r", "y": "q*r", "n": "r*r", "xu": "p*w", "yu": "q*w", "u": "r*w", "xv": "p*w", "yv": "q*w", "v": "r*w"}


@A("agg_16_least_squares", with_sql("sky_stars") + f", terms AS (SELECT star_id % 97 AS system_id, {', '.join(f'{e} AS {n}' for n, e in _SYSTEM.items())} FROM sky_stars), totals AS (SELECT system_id, {', '.join(f'sum({e}) AS s{k}' for k, e in _PRODUCTS.items())} FROM terms GROUP BY system_id), solved AS (SELECT system_id, {_constants()} FROM totals) SELECT system_id, round(a, 4) + 0e0 AS x1, round(b, 4) + 0e0 AS x2, round(c, 4) + 0e0 AS x3 FROM solved")
def agg_16(spark, sf_dir):
    """The general three-unknown form, for every system of stars: the third coefficient is a column, not one."""
    table = fixture(spark, sf_dir, "sky_stars").selectExpr("star_id % 97 AS system_id", *[f"{e} AS {n}" for n, e in _SYSTEM.items()])
    total = table.groupBy("system_id").agg(*[F.sum(F.expr(e)).alias(f"_s_{k}") for k, e in _PRODUCTS.items()])
    found = fit.add_constants(total, {k: F.col(f"_s_{k}") for k in _PRODUCTS})
    return found.select("system_id", *[(F.round(c, 4) + F.lit(0e0)).alias(x) for c, x in zip("abc", ("x1", "x2", "x3"), strict=True)])


_LOO = _UV + f""", with_totals AS (SELECT *, {_sums('OVER (PARTITION BY run_id)')} FROM m), f_all AS (SELECT run_id, quad_id, scale_ratio, {_constants()} FROM with_totals),
    less AS (SELECT run_id, quad_id, {_sums('OVER (PARTITION BY run_id)', True)} FROM m), f_less AS (SELECT run_id, quad_id, {_constants()} FROM less),
    moved AS (SELECT a.run_id, a.quad_id, scale_ratio, {", ".join(f"l.{c} - a.{c} AS d_{c}" for c in "abcdef")} FROM f_all a JOIN f_less l ON l.run_id = a.run_id AND l.quad_id = a.quad_id),
    med AS (SELECT *, median(scale_ratio) OVER (PARTITION BY run_id) AS med FROM moved),
    sig AS (SELECT *, abs(med - scale_ratio) AS d_scale, {", ".join(f"2e0*sqrt(avg(d_{c}*d_{c}) OVER (PARTITION BY run_id)) AS t_{c}" for c in "abcdef")},
                   sqrt(avg((med - scale_ratio)*(med - scale_ratio)) OVER (PARTITION BY run_id))*CASE WHEN med <= 300 THEN 0.66e0 WHEN med >= 1500 THEN 2e0 ELSE (1e0 - (med - 300)/1200e0)*0.66e0 + (med - 300)/1200e0*2e0 END AS t_scale FROM med),
    marked AS (SELECT *, NOT (d_scale > t_scale OR {" OR ".join(f"abs(d_{c}) > t_{c}" for c in "abcdef")}) AS good FROM sig),
    clipped AS (SELECT *, sum(CAST(good AS INTEGER)) OVER (PARTITION BY run_id) AS remain FROM marked QUALIFY remain < 8 OR good)"""


@A("agg_20_influence_clip", _LOO + " SELECT run_id, quad_id FROM clipped")
def agg_20(spark, sf_dir):
    return fit.clip_influence(fit.with_plane(planted(spark, sf_dir))).select("run_id", "quad_id")


@A("win_10_leave_one_out", _LOO + " SELECT run_id, quad_id, round(d_a*1e8, 4) + 0e0 AS d_a, round(d_c*1e5, 4) + 0e0 AS d_c, round(d_scale, 6) AS d_scale FROM sig")
def win_10(spark, sf_dir):
    found = fit.influence(fit.with_plane(planted(spark, sf_dir)))
    return found.select("run_id", "quad_id", (F.round(F.col("d_a") * 1e8, 4) + 0e0).alias("d_a"), (F.round(F.col("d_c") * 1e5, 4) + 0e0).alias("d_c"), r6(F.col("d_scale")).alias("d_scale"))


_PPD = f"""SELECT p.run_id, avg(sqrt((p.x - o.x)*(p.x - o.x) + (p.y - o.y)*(p.y - o.y))/{dist('p.mid_ra', 'p.mid_dec', 'o.mid_ra', 'o.mid_dec')}) AS ppd FROM matches p JOIN matches o ON p.run_id = o.run_id AND p.quad_id < o.quad_id
    WHERE {dist('p.mid_ra', 'p.mid_dec', 'o.mid_ra', 'o.mid_dec')} > 0 AND sqrt((p.x - o.x)*(p.x - o.x) + (p.y - o.y)*(p.y - o.y)) > 0 GROUP BY p.run_id"""


@A("agg_21_pixels_per_degree", _M + f" SELECT run_id, round(ppd, 5) AS pixels_per_degree FROM ({_PPD}) t")
def agg_21(spark, sf_dir):
    found = fit.pixels_per_degree(planted(spark, sf_dir))
    return found.select("run_id", F.round("pixels_per_degree", 5).alias("pixels_per_degree"))


@A("join_10_match_pairs", _M + " SELECT p.run_id, count(*) AS n_pairs FROM matches p JOIN matches o ON p.run_id = o.run_id AND p.quad_id < o.quad_id GROUP BY p.run_id")
def join_10(spark, sf_dir):
    return fit.match_pairs(planted(spark, sf_dir)).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_pairs"))


