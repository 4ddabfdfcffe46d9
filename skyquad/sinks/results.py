"""Solve results as JSON and TSV, benchmark rows as CSV. All columns, no rows in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import angles

#: Keys of a result in their order, and the columns they come from. Those of the first group
#: are there where a picture was solved; of the extended form the second in any case, the third where solved.
FIELDS = {
    "ra": "ra", "dec": "dec", "ra_hms": "ra_hms", "dec_dms": "dec_dms", "fieldRadius": "radius", "orientation": "orientation", "pixScale": "pix_scale",
    "parity": "parity",
}
COUNTERS = {"starsDetected": "stars_detected", "starsUsed": "stars_used", "timeSpent": "time_spent", "searchIterations": "areas_searched"}
EXTENDED = {
    "imageWidth": "width", "imageHeight": "height", "searchRunCenter": "run_center", "searchRunRadius": "run_radius", "quadMatches": "n_matches",
    "fieldWidth": "field_width", "fieldHeight": "field_height",
    "fits_cd1_1": "cd1_1", "fits_cd1_2": "cd1_2", "fits_cd2_1": "cd2_1", "fits_cd2_2": "cd2_2", "fits_cdelt1": "cdelt1", "fits_cdelt2": "cdelt2",
    "fits_crota1": "crota1", "fits_crota2": "crota2", "fits_crpix1": "crpix1", "fits_crpix2": "crpix2", "fits_crval1": "crval1", "fits_crval2": "crval2",
}


def time_text(seconds: Column) -> Column:
    """``hh:mm:ss`` and, where there are parts of a second, seven decimals."""
    ticks = F.round(seconds * 10_000_000).cast("long")
    whole, rest = F.floor(ticks / 10_000_000).cast("long"), ticks % 10_000_000
    shown = F.format_string("%02d:%02d:%02d", F.floor(whole / 3600).cast("long"), F.floor(whole / 60).cast("long") % 60, whole % 60)
    return F.when(rest == 0, shown).otherwise(F.concat(shown, F.format_string(".%07d", rest)))


def with_texts(solutions: DataFrame) -> DataFrame:
    """Adds success (where it isn't there: whether there is a position), ra_hms and dec_dms."""
    success = F.coalesce(F.col("success"), F.lit(False)) if "success" in solutions.columns else F.col("ra").isNotNull()
    return solutions.withColumns({"success": success, "ra_hms": angles.ra_text("ra"), "dec_dms": angles.dec_text("dec")})


def result_fields(columns: list[str], extended: bool = False) -> list[tuple[str, Column]]:
    """Keys and values in order; null where a failed result has no such key."""
    solved = lambda c: F.when(F.col("success"), F.col(c))
    found = [("success", F.col("success")), *((k, solved(c)) for k, c in FIELDS.items() if c in columns)]
    if extended:
        found += [(k, F.col(c)) for k, c in COUNTERS.items() if c in columns]
        found += [(k, solved(c)) for k, c in EXTENDED.items() if c in columns]
    return found


def as_json(solutions: DataFrame, extended: bool = False, pretty: bool = True) -> DataFrame:
    """image_id and json. A result that isn't a success has no more than ``success`` and the counters."""
    rows = with_texts(solutions)
    fields = [v.alias(k) for k, v in result_fields(rows.columns, extended)]
    return rows.select("image_id", F.to_json(F.struct(*fields), {"pretty": str(pretty).lower(), "ignoreNullFields": "true"}).alias("json"))


def as_tsv(solutions: DataFrame, extended: bool = False) -> DataFrame:
    """image_id, line (from 0), key and text ``key<TAB>value``: a row per line."""
    rows = with_texts(solutions)
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in result_fields(rows.columns, extended)])
    lines = rows.select("image_id", F.posexplode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("line", "pair"))
    return lines.select("image_id", F.col("line").cast("long").alias("line"), "pair.key", F.concat_ws("\t", "pair.key", "pair.value").alias("text"))


def average_runs(rows: DataFrame) -> DataFrame:
    """Benchmark rows averaged over the iterations of a configuration: means of the numbers, whether
    any solved, errors joined in order of iteration."""
    numbers = [c for c, kind in rows.dtypes if kind in ("double", "float", "int", "bigint") and c not in ("iteration", "config_id")]
    errors = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("iteration", "errors"))), lambda e: F.coalesce(e["errors"], F.lit(""))), "; ")
    return rows.groupBy("config_id").agg(*[F.avg(c).alias(c) for c in numbers], F.bool_or("solved").alias("solved"), errors.alias("errors"), F.min_by("image_name", "iteration").alias("image_name"))


def write_report(rows: DataFrame, folder: str) -> None:
    rows.write.option("header", True).option("sep", "|").csv(folder)
