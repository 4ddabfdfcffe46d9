"""Deterministic star tables made from business tables, as SQL that Spark and DuckDB both run.

``SQL`` holds the statements by name; they name their sources as plain tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "sky_stars": """
        SELECT star_id,
               CAST(((cents*16807) % 2147483647) % 36000 AS DOUBLE)/1e3 AS ra,
               CAST(((cents*48271) % 2147483647) % 36001 - 18000 AS DOUBLE)/1e3 AS dec,
               CAST(60 + (cust*31) % 110 AS DOUBLE)/1e1 AS mag
        FROM (SELECT CAST(o_orderkey AS BIGINT) AS star_id, o_custkey AS cust, CAST(round(o_totalprice*1e2) AS BIGINT) AS cents FROM orders) t""",
    "image_stars": """
        SELECT CAST(1 AS BIGINT) AS image_id, star_id,
               round(8e2 - xi*1e4 + CAST((star_id*37) % 21 - 10 AS DOUBLE)/1e2, 6) AS x,
               round(6e2 + yn*1e4 + CAST((star_id*53) % 21 - 10 AS DOUBLE)/1e2, 6) AS y,
               CAST(floor(1e6 - mag*1e4) AS BIGINT) AS brightness,
               CAST(1 + star_id % 4 AS DOUBLE) AS size
        FROM (SELECT *,
                cos(radians(dec))*sin(radians(ra-18e0))/dv AS xi,
                (sin(radians(5e-1))*cos(radians(dec))*cos(radians(ra-18e0))
                 - cos(radians(5e-1))*sin(radians(dec)))/dv AS yn
              FROM (SELECT *, cos(radians(5e-1))*cos(radians(dec))*cos(radians(ra-18e0))
                            + sin(radians(5e-1))*sin(radians(dec)) AS dv FROM sky_stars) a) b
        WHERE abs(xi) < 8e-2 AND abs(yn) < 6e-2""",
    "matches": """
        SELECT i.image_id, CAST(i.star_id % 5 AS BIGINT) AS run_id, i.star_id AS quad_id, i.x, i.y, s.ra AS mid_ra, s.dec AS mid_dec,
               174e0 + CAST((i.star_id*29) % 23 AS DOUBLE)/1e1 + CAST((i.star_id*31) % 97 AS DOUBLE)/1e3 + CASE WHEN i.star_id % 11 = 0 THEN 9e0 ELSE 0e0 END AS scale_ratio,
               18.1e0 AS ra0, 0.4e0 AS dec0
        FROM image_stars i JOIN (SELECT star_id, ra, dec FROM sky_stars) s ON i.star_id = s.star_id""",
    "dso": """
        SELECT CAST(p_partkey AS BIGINT) AS dso_id,
               CAST((p_partkey*p_partkey*7919 + p_size*104729) % 360000 AS DOUBLE)/1e3 AS ra,
               CAST((p_partkey*p_partkey*48271 + p_size*31) % 160001 - 80000 AS DOUBLE)/1e3 AS dec,
               p_type AS dso_type, p_name AS name, CAST(p_size AS DOUBLE)*6e1 AS size1
        FROM (SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(p_size AS BIGINT) AS p_size, p_type, p_name FROM part) t""",
    "search_centers": """
        SELECT run_id,
               CAST((run_id*run_id*1237 + nation*7919) % 36000 AS DOUBLE)/1e3 AS ra,
               CAST((run_id*run_id*4447 + nation*31) % 36001 - 18000 AS DOUBLE)/1e3 AS dec,
               1e0 + CAST(nation % 5 AS DOUBLE) AS radius
        FROM (SELECT CAST(s_suppkey AS BIGINT) AS run_id, CAST(s_nationkey AS BIGINT) AS nation FROM supplier) t""",
    "pixels": """
        SELECT CAST(floor(vec_id/64) AS BIGINT) AS image_id, CAST(vec_id % 64 AS BIGINT) AS y, CAST(pos AS BIGINT) AS x,
               CAST(floor(abs(CAST(v AS DOUBLE))*1e3) AS BIGINT) AS v
        FROM (SELECT vec_id, posexplode(embedding) AS (pos, v) FROM embeddings) t""",
}
DUCKDB = SQL | {
    "pixels": SQL["pixels"].replace("posexplode(embedding) AS (pos, v)", "unnest(range(len(embedding))) AS pos, unnest(embedding) AS v"),
}
WIDTH, HEIGHT = 1600, 1200
#: Brighter stars have odd sizes now and then; the planted plate is centred here.
CENTER = (18.0, 0.5)
_PATCH = 1296.0  # square degrees that sky_stars covers


def _sources(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\bFROM (\w+)", sql)))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SQL[name]
    held = {t: fixture(spark, sf_dir, t) if t in SQL else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _sources(sql)}
    return spark.sql(re.sub(r"\bFROM (\w+)", r"FROM {\1}", sql), **held)


def with_sql(*names: str) -> str:
    """``WITH`` clause that defines fixtures for DuckDB, with those they read."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for t in _sources(DUCKDB[name]):
            if t in DUCKDB:
                add(t)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({DUCKDB[n]})" for n in wanted)


def pictures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, WIDTH, HEIGHT)], "image_id long, width long, height long")


def fixture_index_options(stars: DataFrame):
    """Four passes below the catalog's own density; a sparse catalog begins with it."""
    from .operators.index import IndexOptions

    density = star_density(stars)
    return IndexOptions(density if density < 2 else density / 4 if density < 50 else density / 8, last_pass=3)


def star_density(stars: DataFrame) -> float:
    """Stars per square degree of the fixture's patch."""
    return stars.count() / _PATCH
