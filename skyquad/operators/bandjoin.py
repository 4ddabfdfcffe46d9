"""Similarity join of image quads and catalog quads on five ratio bands.

A plain ``BETWEEN`` join would be a nested loop. Here r0 and r1 are cut into logarithmic buckets
as wide as the band; catalog quads keep their one bucket pair, image quads (the smaller side) are
looked up in the nine around theirs. That is an equi-join, and the exact test follows on its rows.
The join carries no hint: Spark broadcasts the image side only where its measured size allows it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import NAMES, agrees, within

TOLERANCE = 0.011


def bucket(ratio: Column, tolerance: float = TOLERANCE) -> Column:
    """A band never reaches beyond the neighbouring buckets. Ratios are over 0."""
    return F.floor(F.log(ratio.cast("double")) / math.log((1 + tolerance) / (1 - tolerance))).cast("int")


def ratio_range(image_quads: DataFrame, tolerance: float = TOLERANCE) -> tuple[float, float]:
    """Least and greatest catalog r0 that can match: two numbers, for the scan's row-group filter."""
    low, high = image_quads.agg(F.min("r0"), F.max("r0")).first()
    return (0.0, 0.0) if low is None else (low / (1 + 2 * tolerance), high / (1 - 2 * tolerance))


def candidates(image_quads: DataFrame, catalog_quads: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """All pairs whose ratios are within the tolerance by either test. Columns of the catalog quad,
    image_id, quad_id, and the image quad's values as i_largest, i_x, i_y; ``is_within`` tells the
    prefilter's test, ``is_match`` the final one. Quads with a ratio of 0 match nothing."""
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    image = image_quads.filter("r0 > 0").select(
        "image_id", "quad_id", *[F.col(r).alias(f"i_{r}") for r in NAMES], F.col("largest").alias("i_largest"),
        F.col("mid_x").alias("i_x"), F.col("mid_y").alias("i_y"),
        F.explode(around).alias("_s0"), bucket(F.col("r0")).alias("_c0"), bucket(F.col("r1")).alias("_c1"),
    )
    image = image.withColumn("_s1", F.explode(around)).withColumns({"_b0": F.col("_c0") + F.col("_s0"), "_b1": F.col("_c1") + F.col("_s1")})
    catalog = catalog_quads.filter("r0 > 0").withColumns({"_b0": bucket(F.col("r0")), "_b1": bucket(F.col("r1"))})
    pairs = catalog.join(image.drop("_s0", "_s1", "_c0", "_c1"), ["_b0", "_b1"])

    def every(test) -> Column:
        tests = [test(F.col(f"i_{r}"), F.col(r), tolerance) for r in NAMES]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    pairs = pairs.withColumns({"is_within": every(within), "is_match": every(agrees)})
    return pairs.filter("is_within or is_match").drop("_b0", "_b1", *[f"i_{r}" for r in NAMES])
