"""Catalog side: cells, subcells, pass selection, catalog quads, index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import fixture_index_options, with_sql
from ..operators import cells, index, lookup, quads
from .base import Registry, band_sql, cells_cte, circle_sql, dist, fixture, r6

REGISTRY = Registry()
_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]
_CENTER = "ra_left + (ra_right - ra_left)/2 AS center_ra, dec_bottom + (dec_top - dec_bottom)/2 AS center_dec"


def stars_ctes() -> str:
    """... sky_stars, cells, idx_stars (as the index keeps them)."""
    return f"""{with_sql("sky_stars")}, {cells_cte()}, widths AS (SELECT DISTINCT band, w FROM bands),
    idx0 AS (SELECT star_id, CAST(CAST(ra AS FLOAT) AS DOUBLE) AS ra, CAST(CAST(dec AS FLOAT) AS DOUBLE) AS dec, CAST(floor(mag*10) AS INTEGER) AS mag10 FROM sky_stars),
    idx1 AS (SELECT *, {band_sql("dec")} AS band FROM idx0),
    idx_stars AS (SELECT i.*, CAST(floor((i.ra % 360e0)/w.w) AS INTEGER) AS cell, printf('b%02dc%02d', i.band, CAST(floor((i.ra % 360e0)/w.w) AS INTEGER)) AS cell_id FROM idx1 i JOIN widths w ON w.band = i.band)"""


def passes_ctes() -> str:
    """... cell_passes, pass_stars."""
    return stars_ctes() + f""",
    base AS (SELECT CASE WHEN d < 2 THEN d WHEN d < 50 THEN d/4e0 ELSE d/8e0 END AS b FROM (SELECT count(*)/1296e0 AS d FROM sky_stars) t),
    sized AS (SELECT *, {_CENTER} FROM cells),
    areas AS (SELECT *, (dec_top - dec_bottom)*{dist("ra_left", "center_dec", "ra_right", "center_dec")} AS area FROM sized),
    cell_passes AS (SELECT a.*, CAST(p AS INTEGER) AS pass, CAST(floor(b*pow(sqrt(2e0), p)*area) AS BIGINT) AS n_stars, CAST(floor(least(greatest(b*pow(sqrt(2e0), p)*area/2e3, 2e0), 12e0)) AS INTEGER) AS d
                    FROM areas a, base, (SELECT unnest(range(4)) AS p) u),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY mag10, star_id) AS rank FROM idx_stars),
    pass_stars AS (
        SELECT r.cell_id, c.pass, r.star_id, r.rank, r.ra, r.dec, r.mag10,
               list_filter(range(c.d), lambda k: c.dec_bottom + k*((c.dec_top - c.dec_bottom)/c.d) <= r.dec AND r.dec <= c.dec_bottom + (k + 1)*((c.dec_top - c.dec_bottom)/c.d))[1]*c.d
               + list_filter(range(c.d), lambda k: c.ra_left + k*((c.ra_right - c.ra_left)/c.d) <= r.ra AND r.ra <= c.ra_left + (k + 1)*((c.ra_right - c.ra_left)/c.d))[1] AS subcell
        FROM ranked r JOIN cell_passes c ON c.cell_id = r.cell_id AND r.rank <= c.n_stars)"""


def quads_ctes() -> str:
    """... quads: the catalog quads of every pass."""
    at = lambda k, c: "s." + c if k == 0 else f"n{k}.{c}"
    sides = ", ".join(dist(at(i, "ra"), at(i, "dec"), at(j, "ra"), at(j, "dec")) for i, j in _PAIRS)
    mean = lambda e: "(" + " + ".join(e.format(ra=at(k, "ra"), dec=at(k, "dec")) for k in range(4)) + ")/4e0"
    level = lambda i, t: f"CAST(CAST(round(CAST(CAST(l[{i + 1}]/l[6] AS FLOAT) AS DOUBLE)*{t}e0) AS FLOAT)*CAST(1e0/{t}e0 AS FLOAT) AS FLOAT) AS r{i}"
    return passes_ctes() + f""",
    grouped AS (SELECT *, count(*) OVER (PARTITION BY cell_id, pass, subcell) AS members FROM pass_stars),
    pairs AS (SELECT a.cell_id, a.pass, a.subcell, a.star_id, a.rank, b.star_id AS other, b.rank AS other_rank, {dist("a.ra", "a.dec", "b.ra", "b.dec")} AS apart
              FROM grouped a JOIN grouped b ON a.cell_id = b.cell_id AND a.pass = b.pass AND a.subcell = b.subcell AND a.star_id <> b.star_id WHERE a.members > 4),
    near AS (SELECT *, row_number() OVER (PARTITION BY cell_id, pass, subcell, star_id ORDER BY apart, other_rank) AS place FROM pairs WHERE apart > 0 QUALIFY place <= 3),
    threes AS (SELECT cell_id, pass, subcell, star_id, rank, max(other) FILTER (place = 1) AS o1, max(other) FILTER (place = 2) AS o2, max(other) FILTER (place = 3) AS o3
               FROM near GROUP BY ALL HAVING count(*) = 3),
    fours AS (SELECT t.cell_id, t.pass, t.subcell, t.rank, list_sort([t.star_id, o1, o2, o3]) AS star_set, list_sort([{sides}]) AS l,
                     {mean("cos(radians({dec}))*cos(radians({ra}))")} AS vx, {mean("cos(radians({dec}))*sin(radians({ra}))")} AS vy, {mean("sin(radians({dec}))")} AS vz
              FROM threes t JOIN idx_stars s ON s.star_id = t.star_id JOIN idx_stars n1 ON n1.star_id = o1 JOIN idx_stars n2 ON n2.star_id = o2 JOIN idx_stars n3 ON n3.star_id = o3),
    once AS (SELECT * FROM fours QUALIFY row_number() OVER (PARTITION BY cell_id, pass, subcell, star_set ORDER BY rank) = 1),
    quads AS (SELECT cell_id, pass, subcell, row_number() OVER (PARTITION BY cell_id, pass, subcell ORDER BY rank) - 1 AS pos, {", ".join(level(i, t) for i, t in enumerate((1023, 1023, 1023, 511, 511)))},
                     CAST(l[6] AS FLOAT) AS largest, CAST(CASE WHEN atan2(vy, vx) < 0 THEN degrees(atan2(vy, vx)) + 360e0 ELSE degrees(atan2(vy, vx)) END AS FLOAT) AS mid_ra,
                     CAST(degrees(atan2(vz, sqrt(vx*vx + vy*vy))) AS FLOAT) AS mid_dec, array_to_string(star_set, ',') AS star_set FROM once)"""


def index_ctes() -> str:
    """... index_pass, index_subcell."""
    return quads_ctes() + f""",
    used AS (SELECT DISTINCT cell_id FROM quads),
    counts AS (SELECT cell_id, pass, count(*) AS n FROM quads GROUP BY ALL),
    index_pass0 AS (SELECT p.cell_id, p.pass, coalesce(n, 0) AS n_quads, CAST(coalesce(n, 0)/area AS FLOAT) AS density, p.d AS divisions,
                           CAST(ra_left + (ra_right - ra_left)/p.d/2 AS FLOAT) AS fr, CAST(dec_bottom + (dec_top - dec_bottom)/p.d/2 AS FLOAT) AS fd,
                           CAST(ra_right - (ra_right - ra_left)/p.d/2 AS FLOAT) AS lr, CAST(dec_top - (dec_top - dec_bottom)/p.d/2 AS FLOAT) AS ld
                    FROM cell_passes p SEMI JOIN used USING (cell_id) LEFT JOIN counts c ON c.cell_id = p.cell_id AND c.pass = p.pass),
    index_pass AS (SELECT cell_id, pass, n_quads, density, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY density, pass) AS INTEGER) AS density_rank, divisions,
                          {dist("CAST(fr AS DOUBLE)", "CAST(fd AS DOUBLE)", "CAST(lr AS DOUBLE)", "CAST(ld AS DOUBLE)")}/(divisions - 1)/2 AS avg_subcell_radius FROM index_pass0),
    subcounts AS (SELECT cell_id, pass, subcell, count(*) AS n FROM quads GROUP BY ALL),
    boxes AS (SELECT cell_id, pass, d, CAST(k AS INTEGER) AS subcell, ra_left, ra_right, dec_bottom, dec_top, k % d AS i, k // d AS j
              FROM (SELECT * FROM cell_passes SEMI JOIN used USING (cell_id)) p, LATERAL (SELECT unnest(range(p.d*p.d)) AS k) u),
    index_subcell AS (SELECT b.cell_id, b.pass, b.subcell, CAST((ra_left + i*((ra_right - ra_left)/d) + (ra_left + (i + 1)*((ra_right - ra_left)/d)))/2 AS FLOAT) AS center_ra,
                             CAST((dec_bottom + j*((dec_top - dec_bottom)/d) + (dec_bottom + (j + 1)*((dec_top - dec_bottom)/d)))/2 AS FLOAT) AS center_dec, coalesce(n, 0) AS n_quads
                      FROM boxes b LEFT JOIN subcounts s ON s.cell_id = b.cell_id AND s.pass = b.pass AND s.subcell = b.subcell)"""


_BUILT: dict[tuple[str, str], index.Index] = {}


def fixture_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """Built and written once per application and folder, then read by all queries that need it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        stars = fixture(spark, sf_dir, "sky_stars")
        _BUILT[key] = index.build_index(stars, fixture_index_options(stars))
    return _BUILT[key]


def fixture_pass_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = fixture(spark, sf_dir, "sky_stars")
    return index.select_pass_stars(stars, fixture_index_options(stars))


A = REGISTRY.add


@A("flt_01_magnitude_cut", with_sql("sky_stars") + " SELECT star_id, mag FROM sky_stars WHERE mag < 12e0")
def flt_01(spark, sf_dir):
    return fixture(spark, sf_dir, "sky_stars").filter(F.col("mag") < 12e0).select("star_id", "mag")


@A("join_01_star_cells", with_sql("sky_stars") + f", {cells_cte()}, widths AS (SELECT DISTINCT band, w FROM bands), b AS (SELECT *, {band_sql('dec')} AS band FROM sky_stars) SELECT star_id, CAST(b.band AS INTEGER) AS band, CAST(floor((ra % 360e0)/w) AS INTEGER) AS cell, printf('b%02dc%02d', b.band, CAST(floor((ra % 360e0)/w) AS INTEGER)) AS cell_id FROM b JOIN widths ON widths.band = b.band")
def join_01(spark, sf_dir):
    return cells.assign_cells(fixture(spark, sf_dir, "sky_stars")).select("star_id", "band", "cell", "cell_id")


@A("snk_02_magnitude_bins", with_sql("sky_stars") + " SELECT CAST(floor(mag) AS BIGINT) AS mag_bin, count(*) AS n FROM sky_stars GROUP BY 1")
def snk_02(spark, sf_dir):
    return fixture(spark, sf_dir, "sky_stars").groupBy(F.floor("mag").alias("mag_bin")).agg(F.count(F.lit(1)).alias("n"))


@A("agg_15_stars_per_cell", stars_ctes() + " SELECT cell_id, CAST(mag10//10 AS INTEGER) AS mag_bin, count(*) AS n FROM idx_stars GROUP BY ALL")
def agg_15(spark, sf_dir):
    stars = index.index_stars(fixture(spark, sf_dir, "sky_stars"))
    return stars.groupBy("cell_id", F.floor(F.col("mag10") / 10).cast("int").alias("mag_bin")).agg(F.count(F.lit(1)).alias("n"))


@A("join_17_stars_of_cell", stars_ctes() + " SELECT star_id, cell_id FROM idx_stars WHERE cell_id IN ('b08c01', 'b09c02')")
def join_17(spark, sf_dir):
    stars = index.index_stars(fixture(spark, sf_dir, "sky_stars"))
    return stars.filter(F.col("cell_id").isin("b08c01", "b09c02")).select("star_id", "cell_id")


@A("join_04_runs_cells", with_sql("search_centers") + f", {cells_cte()} SELECT run_id, cell_id FROM (SELECT run_id, ra AS s_ra, dec AS s_dec, radius AS s_radius FROM search_centers) s, cells WHERE {circle_sql('s_radius', 's_ra', 's_dec')}")
def join_04(spark, sf_dir):
    return cells.runs_to_cells(fixture(spark, sf_dir, "search_centers"), ["run_id"]).select("run_id", "cell_id")


@A("fn_22_cell_size", stars_ctes() + f", sized AS (SELECT *, {_CENTER} FROM cells) SELECT star_id, s.cell_id, round(center_ra, 6) AS center_ra, round(center_dec, 6) + 0e0 AS center_dec, round({dist('ra_left', 'center_dec', 'ra_right', 'center_dec')}, 6) AS width_deg, round(dec_top - dec_bottom, 6) AS height_deg FROM sized s JOIN idx_stars i ON i.cell_id = s.cell_id")
def fn_22(spark, sf_dir):
    """Center and size of the cell that each star lies in."""
    sized = cells.add_bounds_center(cells.sky_cells(spark)).drop("band", "cell")
    stars = fixture(spark, sf_dir, "sky_stars").withColumns({c: F.col(c).cast("float").cast("double") for c in ("ra", "dec")})
    placed = cells.assign_cells(stars).select("star_id", "cell_id").join(F.broadcast(sized), "cell_id")  # 406 rows
    return placed.select("star_id", "cell_id", *[r6(F.col(c)).alias(c) for c in ("center_ra", "center_dec", "width_deg", "height_deg")])


@A("fn_42_subcells", stars_ctes() + ", held AS (SELECT cell_id, count(*) AS n FROM idx_stars GROUP BY cell_id), cut AS (SELECT c.*, 2 + n % 3 AS d FROM cells c JOIN held h ON h.cell_id = c.cell_id) SELECT cell_id, CAST(k AS INTEGER) AS subcell, round(ra_left + (k % d)*((ra_right - ra_left)/d), 6) AS ra_left, round(dec_bottom + (k // d)*((dec_top - dec_bottom)/d), 6) + 0e0 AS dec_bottom FROM cut c, LATERAL (SELECT unnest(range(c.d*c.d)) AS k) u")
def fn_42(spark, sf_dir):
    """Subcells of the cells that hold stars, in as many parts as follow from their number."""
    stars = fixture(spark, sf_dir, "sky_stars").withColumns({c: F.col(c).cast("float").cast("double") for c in ("ra", "dec")})
    held = cells.assign_cells(stars).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    boxes = cells.subdivide(cells.sky_cells(spark).join(held, "cell_id"), (F.col("n") % 3 + 2).cast("int"))
    return boxes.select("cell_id", F.col("subcell").cast("int").alias("subcell"), r6(F.col("ra_left")).alias("ra_left"), r6(F.col("dec_bottom")).alias("dec_bottom"))


@A("flt_08_points_in_box", with_sql("sky_stars") + " SELECT star_id FROM sky_stars WHERE ra >= 10e0 AND ra <= 20e0 AND dec >= -5e0 AND dec <= 5e0")
def flt_08(spark, sf_dir):
    box = fixture(spark, sf_dir, "sky_stars").withColumns({"ra_left": F.lit(10e0), "ra_right": F.lit(20e0), "dec_bottom": F.lit(-5e0), "dec_top": F.lit(5e0)})
    return box.filter(cells.inside("ra", "dec")).select("star_id")


@A("win_06_pass_stars", passes_ctes() + " SELECT cell_id, pass, star_id, rank FROM pass_stars")
def win_06(spark, sf_dir):
    return fixture_pass_stars(spark, sf_dir).select("cell_id", "pass", "star_id", F.col("rank").cast("long").alias("rank"))


@A("join_07_star_subcells", passes_ctes() + " SELECT cell_id, pass, star_id, CAST(subcell AS INTEGER) AS subcell FROM pass_stars")
def join_07(spark, sf_dir):
    return fixture_pass_stars(spark, sf_dir).select("cell_id", "pass", "star_id", "subcell")


@A("top_03_by_magnitude", passes_ctes() + " SELECT cell_id, star_id, mag10 FROM pass_stars WHERE rank <= 5 AND pass = 0")
def top_03(spark, sf_dir):
    return fixture_pass_stars(spark, sf_dir).filter("rank <= 5 and pass = 0").select("cell_id", "star_id", "mag10")


_DOUBLES = ", ".join(f"round(CAST({c} AS DOUBLE), 5) + 0e0 AS {c}" for c in ("r0", "r1", "r2", "r3", "r4", "largest", "mid_ra", "mid_dec"))


def as_doubles(df: DataFrame) -> list:
    return [(F.round(F.col(c).cast("double"), 5) + 0e0).alias(c) for c in ("r0", "r1", "r2", "r3", "r4", "largest", "mid_ra", "mid_dec")]


@A("sol_02_catalog_quads", quads_ctes() + f" SELECT cell_id, pass, CAST(subcell AS INTEGER) AS subcell, pos, {_DOUBLES}, star_set FROM quads")
def sol_02(spark, sf_dir):
    found = quads.catalog_quads(fixture_pass_stars(spark, sf_dir))
    return found.select("cell_id", "pass", "subcell", "pos", *as_doubles(found), F.array_join(F.array_sort("star_ids"), ",").alias("star_set"))


@A("join_09_catalog_neighbours", quads_ctes() + " SELECT cell_id, pass, CAST(subcell AS INTEGER) AS subcell, count(*) AS n_quads, CAST(sum(rank) AS BIGINT) AS rank_sum FROM once GROUP BY ALL")
def join_09(spark, sf_dir):
    stars = fixture_pass_stars(spark, sf_dir)
    found = quads.catalog_quads(stars).select("cell_id", "pass", "subcell", F.col("star_ids")[0].alias("star_id"))
    ranked = found.join(stars.select("cell_id", "pass", "star_id", "rank"), ["cell_id", "pass", "star_id"])
    return ranked.groupBy("cell_id", "pass", "subcell").agg(F.count(F.lit(1)).alias("n_quads"), F.sum("rank").alias("rank_sum"))


@A("agg_13_distinct_catalog_quads", quads_ctes() + " SELECT count(*) AS n_quads, (SELECT count(*) FROM fours) - count(*) AS n_repeats FROM quads")
def agg_13(spark, sf_dir):
    stars = fixture_pass_stars(spark, sf_dir)
    members = stars.groupBy("cell_id", "pass", "subcell").agg(F.count(F.lit(1)).alias("n"))
    formed = members.filter("n > 4").agg(F.sum("n").alias("formed"))  # each star forms one quad, coincident pairs aside
    kept = quads.catalog_quads(stars).agg(F.count(F.lit(1)).alias("n_quads"))
    return kept.join(formed, F.lit(True)).select("n_quads", (F.col("formed") - F.col("n_quads")).alias("n_repeats"))


@A("agg_14_pass_density", index_ctes() + " SELECT cell_id, pass, n_quads, round(CAST(density AS DOUBLE), 5) AS density FROM index_pass")
def agg_14(spark, sf_dir):
    return fixture_index(spark, sf_dir).passes.select("cell_id", "pass", "n_quads", F.round(F.col("density").cast("double"), 5).alias("density"))


@A("win_05_density_rank", index_ctes() + " SELECT cell_id, pass, density_rank FROM index_pass")
def win_05(spark, sf_dir):
    return fixture_index(spark, sf_dir).passes.select("cell_id", "pass", "density_rank")


@A("fn_44_subcell_radius", index_ctes() + " SELECT cell_id, pass, divisions, round(avg_subcell_radius, 5) AS avg_subcell_radius FROM index_pass")
def fn_44(spark, sf_dir):
    return fixture_index(spark, sf_dir).passes.select("cell_id", "pass", "divisions", F.round("avg_subcell_radius", 5).alias("avg_subcell_radius"))


@A("snk_04_index_subcells", index_ctes() + " SELECT cell_id, pass, subcell, round(CAST(center_ra AS DOUBLE), 4) AS center_ra, round(CAST(center_dec AS DOUBLE), 4) + 0e0 AS center_dec, n_quads FROM index_subcell")
def snk_04(spark, sf_dir):
    found = fixture_index(spark, sf_dir).subcells
    return found.select("cell_id", "pass", "subcell", F.round(F.col("center_ra").cast("double"), 4).alias("center_ra"), (F.round(F.col("center_dec").cast("double"), 4) + 0e0).alias("center_dec"), "n_quads")


@A("win_01_first_rows", index_ctes() + " SELECT cell_id, pass, subcell, n_quads, CAST(sum(n_quads) OVER (PARTITION BY cell_id ORDER BY pass, subcell ROWS UNBOUNDED PRECEDING) - n_quads AS BIGINT) AS first_row FROM index_subcell")
def win_01(spark, sf_dir):
    return fixture_index(spark, sf_dir).subcells.select("cell_id", "pass", "subcell", "n_quads", "first_row")


@A("snk_06_build_stats", quads_ctes() + " SELECT count(*) AS n_quads, count(DISTINCT cell_id) AS n_cells, count(DISTINCT pass) AS n_passes FROM quads")
def snk_06(spark, sf_dir):
    found = quads.catalog_quads(fixture_pass_stars(spark, sf_dir))
    return found.agg(F.count(F.lit(1)).alias("n_quads"), F.count_distinct("cell_id").alias("n_cells"), F.count_distinct("pass").alias("n_passes"))


@A("agg_29_total_quads", quads_ctes() + " SELECT pass, count(*) AS n_quads FROM quads GROUP BY pass")
def agg_29(spark, sf_dir):
    return quads.catalog_quads(fixture_pass_stars(spark, sf_dir)).groupBy("pass").agg(F.count(F.lit(1)).alias("n_quads"))


@A("join_12_unfinished_cells", stars_ctes() + " SELECT cell_id, count(*) AS n FROM idx_stars WHERE cell_id NOT IN (SELECT cell_id FROM cells WHERE band = 9) GROUP BY cell_id")
def join_12(spark, sf_dir):
    done = cells.sky_cells(spark).filter("band = 9").select("cell_id")
    left = index.index_stars(fixture(spark, sf_dir, "sky_stars")).join(F.broadcast(done), "cell_id", "left_anti")
    return left.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))


@A("snk_01_partitioned_stars", stars_ctes() + " SELECT cell_id, count(*) AS n, CAST(sum(star_id) AS BIGINT) AS id_sum FROM idx_stars GROUP BY cell_id")
def snk_01(spark, sf_dir):
    from ..sinks.tables import write_stars

    folder = write_stars(fixture(spark, sf_dir, "sky_stars"))
    return spark.read.parquet(folder).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.sum("star_id").alias("id_sum"))


@A("snk_05_resumed_build", quads_ctes() + " SELECT cell_id, count(*) AS n_quads FROM quads GROUP BY cell_id")
def snk_05(spark, sf_dir):
    """Builds part of the sky, then resumes with all of it."""
    from ..storage import new_folder

    stars = fixture(spark, sf_dir, "sky_stars")
    options, folder = fixture_index_options(stars), new_folder(spark, "index")
    index.write_index(stars.filter("dec > 0.000001"), folder, options)
    whole = index.write_index(stars, folder, options)
    return whole.quads.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_quads"))


@A("set_04_ladder_of_two_builds", index_ctes() + " SELECT cell_id, CAST(2*count(*) AS BIGINT) AS n_passes FROM index_pass GROUP BY cell_id")
def set_04(spark, sf_dir):
    """Passes of two index folders form one ladder by cell."""
    from ..storage import new_folder

    stars = fixture(spark, sf_dir, "sky_stars")
    folders = [new_folder(spark, "index") for _ in range(2)]
    for folder in folders:
        index.write_index(stars, folder, fixture_index_options(stars))
    both = index.read_index(spark, *folders)
    ranks = both.passes.groupBy("cell_id").agg(F.max("density_rank").cast("long").alias("n_passes"))
    return ranks


def slices(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Every quad of the index with the slice of its subcell that it lies in: one scan."""
    built = fixture_index(spark, sf_dir)
    keys = ["cell_id", "pass", "subcell"]
    known = built.subcells.select(*keys, "n_quads")
    return built.quads.join(known, keys).withColumn("slice", lookup.slice_number("pos", "n_quads", n))


@A("win_02_slices", quads_ctes() + " SELECT cell_id, pass, CAST(subcell AS INTEGER) AS subcell, pos, CAST(CASE WHEN n//4 = 0 THEN 3 ELSE least(3, pos//(n//4)) END AS INTEGER) AS slice FROM (SELECT *, count(*) OVER (PARTITION BY cell_id, pass, subcell) AS n FROM quads) t")
def win_02(spark, sf_dir):
    return slices(spark, sf_dir, 4).select("cell_id", "pass", "subcell", "pos", "slice")


__all__ = ["REGISTRY", "fixture_index", "index_ctes", "quads_ctes"]
