"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregate and a join over edges, and every round ends with a distinct; the table
between two rounds is written to the shared folder. The number of rounds is logarithmic in the size of a component, and
no component is ever gathered in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _large_star(edges: DataFrame) -> DataFrame:
    """One row per edge; repeats among them go in the small-star step."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    ends = edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return ends.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: long columns a and b, in any order and number. Returns (node, root) for every
    node that isn't the least of its component; root is the least node."""
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    pairs, before = stash(pairs, "edges"), None
    while True:
        row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not row[0] or tuple(row) == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(row)
        pairs = stash(_small_star(_large_star(pairs)), "edges")
