"""Objects in circles by tiles: poles, the seam, circles of any size, and what the join may cost."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from skyquad.functions.sphere import angular_distance
from skyquad.operators.annotate import objects_in_radius


def test_tiles_find_what_all_distances_find(spark):
    rng = random.Random(3)
    sky = [(i, rng.uniform(0, 360), rng.uniform(-90, 90)) for i in range(2500)] + [(-1, 0.0, 90.0), (-2, 123.0, -90.0), (-3, 360.0, 0.0), (-4, 359.9999, 45.0), (-5, None, 1.0)]
    around = [(0.0, 0.0), (359.9, 30.0), (10.0, 89.5), (200.0, -89.9), (77.0, 90.0), (5.0, -90.0), (180.0, 60.0), (33.0, -75.0)]
    circles = [(i * 10 + j, ra, dec, r) for i, (ra, dec) in enumerate(around) for j, r in enumerate((0.0, 0.7, 5.0, 15.0, 40.0, 89.9, 95.0, 180.0))]
    objects = spark.createDataFrame(sky, "object_id long, ra double, dec double")
    asked = spark.createDataFrame([*circles, (900, float("nan"), 0.0, 3.0), (901, 1.0, 0.0, None)], "run_id long, ra double, dec double, radius double")
    c = asked.select("run_id", F.col("ra").alias("c_ra"), F.col("dec").alias("c_dec"), "radius").filter("not isnan(c_ra)")
    want = objects.filter("ra is not null").crossJoin(c).withColumn("distance", angular_distance("ra", "dec", "c_ra", "c_dec")).filter("distance <= radius")
    key = ["run_id", "object_id", "ra", "dec", "distance"]
    assert sorted(objects_in_radius(objects, asked).select(key).collect()) == sorted(want.select(key).collect())


def test_work_is_dealt_and_nothing_that_grows_is_broadcast(spark):
    """Twenty thousand objects lay in one partition and met every circle of their cell there."""
    objects = spark.range(20000, numPartitions=1).selectExpr("id", "CAST(id * 7919 % 36000 AS DOUBLE)/1e3 AS ra", "CAST(id * 104729 % 36000 AS DOUBLE)/1e3 - 18 AS dec")
    circles = spark.range(50, numPartitions=1).selectExpr("id AS run_id", "CAST(id AS DOUBLE)*0.7 AS ra", "CAST(id AS DOUBLE)*0.7 - 18 AS dec", "2e0 AS radius")
    found = objects_in_radius(objects, circles)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.groupBy(F.spark_partition_id()).count().count() == 4
