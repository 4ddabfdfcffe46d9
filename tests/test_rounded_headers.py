"""Headers whose values lie halfway between two of the steps they are rounded to."""

from __future__ import annotations

from oracle import connect, differences

from skyquad import queries as engine


def test_values_next_to_a_half_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    # Of 900,000 orders (sf0.1 six times, keys shifted) the one whose CD1_1 came out a step higher.
    duckdb.sql(f"COPY (SELECT CAST({ORDER[0]} AS BIGINT) AS o_orderkey, CAST({ORDER[1]} AS BIGINT) AS o_custkey, CAST({ORDER[2]} AS DOUBLE) AS o_totalprice) TO '{tmp_path}/orders.parquet'")
    name = "snk_07_wcs_files"
    assert differences(engine.queries()[name](spark, str(tmp_path)), connect(str(tmp_path)), engine.oracle_sql()[name]) == []


ORDER = (274052, 20681, 232556.64)
