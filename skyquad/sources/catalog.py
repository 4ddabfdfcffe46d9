"""Star catalogs: gzip CSV, packed binary records, deep-sky objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.angles import positive_ra
from ..functions.base import Value, col

#: Positions of RA, Dec and magnitude in the star catalog's lines.
CSV_COLUMNS = (5, 7, 50)
MAX_MAGNITUDE = 17.0
_RECORD = np.dtype([("ra", "<f8"), ("dec", "<f8"), ("mag", "<f4")])
#: Object types by catalog code.
OBJECT_TYPES = {"Gxy": "Galaxy", "Neb": "Nebula", "PN": "PlanetaryNebula", "OC": "OpenCluster"}
_OBJECT_FIELDS = ["ra", "dec", "type", "const", "mag", "name", "rarad", "decrad", "id", "r1", "r2", "angle", "dso_source", "id1", "cat1", "id2", "cat2", "dupid", "dupcat", "display_mag"]


def read_star_csv(spark: SparkSession, path: str, max_magnitude: float = MAX_MAGNITUDE, partitions: int | None = None) -> DataFrame:
    """ra, dec, mag of stars brighter than the limit. A gzip file can't be split, so its rows may be
    dealt anew with ``partitions``; catalogs of many files don't need that. Lines without numbers
    in the three columns are left out."""
    lines = spark.read.option("header", True).csv(path)
    ra, dec, mag = (F.col(f"`{lines.columns[i]}`").try_cast("double") for i in CSV_COLUMNS)
    stars = lines.select(ra.alias("ra"), dec.alias("dec"), mag.alias("mag")).filter((F.col("mag") < max_magnitude) & F.col("ra").isNotNull() & F.col("dec").isNotNull())
    return stars.repartition(partitions) if partitions else stars


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            found = np.frombuffer(content.as_buffer(), _RECORD)
            for at in range(0, len(found), 65_536):
                part = found[at : at + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[c]).astype(float)) for c in _RECORD.names], _RECORD.names)


def read_star_records(spark: SparkSession, path: str) -> DataFrame:
    """Files of 20-byte little-endian records: RA and Dec as doubles, magnitude as a float."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_records, "ra double, dec double, mag double")


def object_type(code: Value) -> Column:
    table = F.create_map(*[F.lit(x) for pair in OBJECT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, col(code)), F.lit("Other"))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Deep-sky objects: RA in degrees, sizes in arc seconds (5 where the first is missing)."""
    lines = spark.read.option("header", True).csv(path).toDF(*_OBJECT_FIELDS)
    number = lambda c: F.col(c).try_cast("double")
    return lines.filter(number("ra").isNotNull() & number("dec").isNotNull()).select(
        positive_ra(number("ra") / 24 * 360).alias("ra"), number("dec").alias("dec"), object_type(F.coalesce("type", F.lit(""))).alias("dso_type"),
        "name", F.coalesce(number("angle"), F.lit(0e0)).alias("angle"), "cat1", "id1", "cat2", "id2",
        F.coalesce(number("r1") * 60, F.lit(5e0)).alias("size1"), F.coalesce(number("r2") * 60, F.lit(0e0)).alias("size2"),
    )
