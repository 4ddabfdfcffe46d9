"""Search plans: for every search center of the tables, and against it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import with_sql
from ..plans import pictures, runs
from .base import Registry, cells_cte, dist, fixture, r6
from .catalog import stars_ctes

REGISTRY = Registry()
_BLIND = runs.BlindOptions(8.0, 2.0)

_BLIND_CTES = """
    levels AS (SELECT level, 8e0/pow(2, level) AS radius FROM (SELECT unnest(range(3)) AS level) t),
    grid AS (SELECT level, radius, q, n, least(n*radius, 90e0) AS dec
             FROM levels, LATERAL (SELECT unnest(range(4)) AS q) a, LATERAL (SELECT unnest(range(CAST(ceil(90e0/radius) AS BIGINT) + 1)) AS n) b),
    counted AS (SELECT *, CAST(ceil(cos(radians(dec))*180e0/(2e0*radius)) AS BIGINT) + 1 AS k FROM grid),
    placed AS (SELECT *, CAST(180e0/k AS FLOAT) AS step FROM counted, LATERAL (SELECT unnest(range(k)) AS i) c),
    found AS (SELECT *, CAST(CAST(CAST((n % 2)*0.5e0 AS FLOAT)*step + CAST(i AS FLOAT)*step AS FLOAT) % CAST(180 AS FLOAT) AS FLOAT) AS a FROM placed),
    blind AS (SELECT row_number() OVER (ORDER BY level, q, n, i) - 1 AS run_id, CAST(CAST(CASE WHEN q % 2 = 1 THEN a + CAST(180 AS FLOAT) ELSE a END AS FLOAT) AS DOUBLE) AS ra,
           CASE WHEN q >= 2 THEN -dec ELSE dec END + 0e0 AS dec, radius
    FROM found)"""
#: Circles around every center, by rows of Dec.
_AROUND = with_sql("search_centers") + f""",
    asked AS (SELECT run_id AS image_id, ra AS c_ra, dec AS c_dec, radius FROM search_centers),
    rws AS (SELECT *, greatest(c_dec - 1e1, -90e0) + n*radius AS dec FROM asked, LATERAL (SELECT unnest(range(CAST(floor((least(c_dec + 1e1, 90e0) - greatest(c_dec - 1e1, -90e0))/radius) AS BIGINT) + 1)) AS n) u),
    counted AS (SELECT *, CAST(ceil(cos(radians(dec))*360e0/(radius*2e0)) AS BIGINT) + 1 AS k FROM rws),
    placed AS (SELECT *, CAST(360e0/k AS FLOAT) AS step FROM counted, LATERAL (SELECT unnest(range(k)) AS i) b),
    around AS (SELECT *, CAST(CAST(CAST(CAST((n % 2)*0.5e0 AS FLOAT)*step + CAST(i AS FLOAT)*step AS FLOAT) % CAST(360 AS FLOAT) AS FLOAT) AS DOUBLE) AS ra FROM placed),
    measured AS (SELECT *, {dist("ra", "dec", "c_ra", "c_dec")} AS distance FROM around),
    nearby AS (SELECT image_id, ra, dec, radius, distance FROM measured WHERE distance < 1e1 UNION ALL SELECT image_id, c_ra, c_dec, radius, 0e0 FROM asked)"""


def centers(spark, sf_dir):
    """Pictures whose headers tell a position and a view: half the diagonal is the center's radius."""
    rows = fixture(spark, sf_dir, "search_centers")
    return rows.select(F.col("run_id").alias("image_id"), F.struct("ra", "dec").alias("center"), F.struct((F.col("radius") * 1.2).alias("width_deg"), (F.col("radius") * 1.6).alias("height_deg")).alias("view"))


@REGISTRY.add("gen_01_sky_cells", stars_ctes() + ", held AS (SELECT cell_id, count(*) AS n FROM idx_stars GROUP BY cell_id) SELECT CAST(band AS INTEGER) AS band, cell, c.cell_id, CAST(band*1000 + cell AS INTEGER) AS cell_num, ra_left, ra_right, dec_bottom, dec_top, coalesce(n, 0) AS n_stars FROM cells c LEFT JOIN held h ON h.cell_id = c.cell_id")
def gen_01(spark, sf_dir):
    """All cells, with the stars that each holds."""
    from ..operators.cells import assign_cells, sky_cells

    stars = fixture(spark, sf_dir, "sky_stars").withColumns({c: F.col(c).cast("float").cast("double") for c in ("ra", "dec")})
    held = assign_cells(stars).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    return sky_cells(spark).join(held, "cell_id", "left").withColumn("n_stars", F.coalesce("n", F.lit(0).cast("long"))).drop("n")


@REGISTRY.add("gen_02_blind_runs", with_sql("search_centers") + f", {_BLIND_CTES} SELECT s.run_id AS place_id, min(b.run_id) AS run_id, count(*) AS n_runs FROM search_centers s JOIN blind b ON {dist('b.ra', 'b.dec', 's.ra', 's.dec')} < b.radius GROUP BY s.run_id")
def gen_02(spark, sf_dir):
    """The first circle of the blind queue that holds each search center, and how many do."""
    places = fixture(spark, sf_dir, "search_centers").select(F.col("run_id").alias("place_id"), "ra", "dec")
    return runs.first_run_at(runs.blind_runs(spark, _BLIND), places)


@REGISTRY.add("gen_03_nearby_runs", _AROUND + " SELECT image_id, round(ra, 4) AS ra, round(dec, 6) + 0e0 AS dec, radius FROM nearby")
def gen_03(spark, sf_dir):
    found = pictures.hinted_runs(centers(spark, sf_dir))
    return found.select("image_id", F.round("ra", 4).alias("ra"), r6(F.col("dec")).alias("dec"), "radius")


@REGISTRY.add("gen_04_point_run", with_sql("search_centers") + " SELECT run_id AS image_id, CAST(0 AS BIGINT) AS run_id, ra, dec, radius FROM search_centers")
def gen_04(spark, sf_dir):
    return runs.point_runs_of(fixture(spark, sf_dir, "search_centers").withColumnRenamed("run_id", "image_id"))


@REGISTRY.add("gen_05_explicit_runs", with_sql("search_centers") + " SELECT run_id, ra, dec, radius FROM (SELECT row_number() OVER (ORDER BY run_id) - 1 AS run_id, ra, dec, radius FROM search_centers) t")
def gen_05(spark, sf_dir):
    return runs.explicit_runs(fixture(spark, sf_dir, "search_centers")).select("run_id", "ra", "dec", "radius")


@REGISTRY.add("gen_06_density_offsets", with_sql("search_centers") + " SELECT run_id, unnest(range(-(run_id % 3), run_id % 2 + 1)) AS density_offset FROM search_centers")
def gen_06(spark, sf_dir):
    found = fixture(spark, sf_dir, "search_centers")
    return found.select("run_id", F.explode(runs.density_offsets(F.col("run_id") % 3, F.col("run_id") % 2)).alias("density_offset"))


@REGISTRY.add("gen_07_variations", with_sql("search_centers") + """
    SELECT run_id AS image_id, CAST(s AS INTEGER) AS sampling, 0.5e0 AS min_radius, CAST(r AS DOUBLE) AS max_radius, 0 AS lower_offset, CAST(h AS INTEGER) AS higher_offset
    FROM search_centers, (SELECT unnest([1, 2, 4, 6, 8, 12, 16]) AS s) a, (SELECT unnest([16, 8, 4]) AS r) b, (SELECT unnest([0, 1]) AS h) c""")
def gen_07(spark, sf_dir):
    """Every setting of a benchmark for every picture."""
    asked = fixture(spark, sf_dir, "search_centers").select(F.col("run_id").alias("image_id"))
    return runs.variations_of(asked, [1, 2, 4, 6, 8, 12, 16], [(0.5, 16), (8, 0.5), (0.5, 4)], [(0, 0), (0, 1)])


@REGISTRY.add("join_16_run_sectors", with_sql("search_centers") + f""", {_BLIND_CTES},
    sectors AS (SELECT run_id, ra, dec, radius, CAST(greatest(0, ceil(ra/60e0) - 1) AS BIGINT) AS sector FROM blind),
    places AS (SELECT run_id AS place_id, ra AS at_ra, dec AS at_dec, CAST(greatest(0, ceil(ra/60e0) - 1) AS BIGINT) AS place_sector FROM search_centers),
    held AS (SELECT s.run_id, s.sector, p.place_id, p.place_sector FROM sectors s LEFT JOIN places p ON {dist('s.ra', 's.dec', 'p.at_ra', 'p.at_dec')} < s.radius)
    SELECT run_id, sector, place_id, place_sector FROM held
    UNION ALL SELECT NULL, NULL, place_id, place_sector FROM places p WHERE NOT EXISTS (SELECT 1 FROM sectors s WHERE {dist('s.ra', 's.dec', 'p.at_ra', 'p.at_dec')} < s.radius)""")
def join_16(spark, sf_dir):
    """Every run of the blind queue with its slice, and every search center with its own: beside the runs
    that hold it, or alone if none does."""
    places = fixture(spark, sf_dir, "search_centers").select(F.col("run_id").alias("place_id"), "ra", "dec")
    return runs.sectors_at(runs.blind_runs(spark, _BLIND), places, 6)


@REGISTRY.add("win_07_row_stagger", _AROUND + " SELECT image_id, CAST(n AS INTEGER) AS n, round(min(ra), 4) AS first_ra, count(*) AS n_circles FROM around GROUP BY image_id, n")
def win_07(spark, sf_dir):
    """Where the first circle of each row around each center lies: every other row is moved by half a step."""
    asked = fixture(spark, sf_dir, "search_centers").select(F.col("run_id").alias("image_id"), F.col("ra").alias("c_ra"), F.col("dec").alias("c_dec"), "radius")
    found = pictures.circles_around(asked, 10.0)
    return found.groupBy("image_id", "n").agg(F.round(F.min("ra"), 4).alias("first_ra"), F.count(F.lit(1)).alias("n_circles"))


#: The centers as a queue, the largest radius first.
_QUEUE = with_sql("search_centers") + ", queue AS (SELECT row_number() OVER (ORDER BY radius DESC, run_id) - 1 AS run_id, ra, dec, radius FROM search_centers)"


def queue_of_centers(spark, sf_dir):
    rows = fixture(spark, sf_dir, "search_centers")
    return runs.explicit_runs(rows.withColumn("run_id", (F.lit(100) - F.col("radius").cast("long")) * 1_000_000_000 + F.col("run_id")))


@REGISTRY.add("win_09_batches", _QUEUE + " SELECT run_id, radius, (rn - 1)//7 AS batch FROM (SELECT *, row_number() OVER (PARTITION BY radius ORDER BY run_id) AS rn FROM queue) u")
def win_09(spark, sf_dir):
    return runs.in_batches(queue_of_centers(spark, sf_dir), 7).select("run_id", "radius", "batch")


@REGISTRY.add("agg_25_radius_groups", _QUEUE + " SELECT radius, CAST(dense_rank() OVER (ORDER BY radius DESC) AS INTEGER) AS radius_group, count(*) AS n, min(run_id) AS first_run FROM queue GROUP BY radius")
def agg_25(spark, sf_dir):
    return runs.by_radius(queue_of_centers(spark, sf_dir)).groupBy("radius", "radius_group").agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("first_run"))


@REGISTRY.add("top_06_nearest_first", _AROUND + " SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY distance) - 1 AS run_id, round(distance, 6) AS distance FROM nearby")
def top_06(spark, sf_dir):
    """The distance at each place of each center's queue."""
    return pictures.hinted_runs(centers(spark, sf_dir)).select("image_id", "run_id", r6(F.col("distance")).alias("distance"))
