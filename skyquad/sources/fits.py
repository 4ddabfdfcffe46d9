"""FITS pictures and star lists. Headers are read with column expressions; pixels are decoded in
Arrow batches, a picture at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.angles import dec_text_to_degrees, positive_ra, ra_text_to_degrees
from ..functions.base import Value, col

BLOCK, RECORD = 2880, 80
_HEADER_BLOCKS = (64, 4096)  # searched for END before the whole file is


def record_keyword(record: Value) -> Column:
    return F.rtrim(F.substring(col(record), 1, 8))


def record_value(record: Value) -> Column:
    """Quoted strings keep their quotes; else what stands before a comment. COMMENT records have no
    value indicator."""
    record = col(record)
    data = F.trim(F.when(record_keyword(record) == "COMMENT", F.substring(record, 9, 72)).otherwise(F.substring(record, 10, 71)))
    return F.when(data.startswith("'"), F.regexp_extract(data, "^('[^']*')", 1)).otherwise(F.trim(F.split_part(data, F.lit("/"), F.lit(1))))


def header_records(content: Value) -> Column:
    """The records before END as an array of texts; null without END. Headers are short, so the file's
    beginning is searched first."""
    return F.coalesce(*[_records_in(F.substring(col(content), 1, BLOCK * n)) for n in _HEADER_BLOCKS], _records_in(col(content)))


def _records_in(content: Column) -> Column:
    text = F.decode(content, "ISO-8859-1")
    count = F.floor(F.length(text) / RECORD).cast("int")
    cut = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.substring(text, i * RECORD + 1, F.lit(RECORD))))
    keys = F.transform(cut, lambda r: F.rtrim(F.substring(r, 1, 8)))
    end = F.array_position(keys, "END").cast("int")
    return F.when(end > 0, F.slice(cut, 1, end - 1))


def header_map(records: Value) -> Column:
    """Keyword to value text; the first of repeated keywords, without comments."""
    pairs = F.transform(col(records), lambda r: F.struct(record_keyword(r).alias("k"), record_value(r).alias("v")))
    named = F.filter(pairs, lambda p: ~p["k"].isin("COMMENT", "HISTORY", ""))
    keys = F.array_distinct(F.transform(named, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(named, lambda p: p["k"] == k)[0]["v"]))


def is_fits(content: Value) -> Column:
    """The first record is SIMPLE = T, and there is at least one block."""
    first = F.decode(F.substring(col(content), 1, RECORD), "ISO-8859-1")
    return (F.length(col(content)) >= BLOCK) & (record_keyword(first) == "SIMPLE") & (record_value(first) == "T")


def _number(headers: Value, key: str) -> Column:
    return F.try_element_at(col(headers), F.lit(key)).try_cast("double")


def _text(headers: Value, key: str) -> Column:
    return F.trim(F.regexp_replace(F.try_element_at(col(headers), F.lit(key)), "['\"]", ""))


def center_position(headers: Value) -> Column:
    """Struct of ra and dec: RA/DEC, else RA_OBJ/DEC_OBJ, else sexagesimal OBJCTRA/OBJCTDEC, else null."""

    def pair(ra: Column, dec: Column) -> Column:
        return F.when(ra.isNotNull() & dec.isNotNull(), F.struct(positive_ra(ra).alias("ra"), dec.alias("dec")))

    plain = [pair(_number(headers, a), _number(headers, b)) for a, b in (("RA", "DEC"), ("RA_OBJ", "DEC_OBJ"))]
    return F.coalesce(*plain, pair(ra_text_to_degrees(_text(headers, "OBJCTRA")), dec_text_to_degrees(_text(headers, "OBJCTDEC"))))


def view_size(headers: Value) -> Column:
    """Struct of width_deg and height_deg from pixel size, binning (1 if missing) and focal length;
    null where one of the others is missing."""
    focal = _number(headers, "FOCALLEN")

    def side(axis: int, binning: str) -> Column:
        chip = _number(headers, f"PIXSIZE{axis}") * F.coalesce(_number(headers, binning), F.lit(1e0)) * _number(headers, f"NAXIS{axis}") / 1000e0
        return F.degrees(F.atan(chip / (focal * 2)) * 2)

    wide, high = side(1, "XBINNING"), side(2, "YBINNING")
    return F.when(wide.isNotNull() & high.isNotNull(), F.struct(wide.alias("width_deg"), high.alias("height_deg")))


def fits_pictures(files: DataFrame) -> DataFrame:
    """path, headers, width, height, bits, offset (of the pixels), center, view, the pixel bytes and
    error of every FITS file among ``files`` (path, content). Two-dimensional pictures of 8, 16 or 32
    bits are read; others have no pixels, and the error tells why."""
    files = files.filter(is_fits("content")).withColumn("records", header_records("content")).withColumn("headers", header_map("records"))
    sized = files.withColumns({
        "width": _number("headers", "NAXIS1").cast("long"), "height": _number("headers", "NAXIS2").cast("long"), "bits": _number("headers", "BITPIX").cast("int"),
        "offset": (F.ceil((F.size("records") + 1) * RECORD / BLOCK) * BLOCK).cast("long"),
    })
    length = (F.col("width") * F.col("height") * F.col("bits") / 8).cast("int")
    pixels = F.substring("content", F.col("offset").cast("int") + 1, length)
    error = (
        F.when(F.col("records").isNull(), "FITS: no END record")
        .when(~F.coalesce(_number("headers", "NAXIS") == 2, F.lit(False)), "FITS: not two-dimensional")
        .when(~F.coalesce(F.col("bits").isin(8, 16, 32), F.lit(False)), "FITS: bits of a pixel")
        .when(F.coalesce(F.octet_length(pixels) < length, F.lit(True)), "FITS: pixels are missing")
    )
    sized = sized.withColumn("error", error)
    return sized.select(
        "path", "headers", "width", "height", "bits", "offset", center_position("headers").alias("center"), view_size("headers").alias("view"),
        F.when(F.col("error").isNull(), pixels).alias("data"), "error",
    )


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    return fits_pictures(spark.read.format("binaryFile").load(path))


def samples(data, bits: int) -> np.ndarray:
    """Big-endian samples of 8, 16 or 32 bits as whole numbers; signed ones are moved up so that the least is 0."""
    values = np.frombuffer(data, {8: ">u1", 16: ">i2", 32: ">i4"}[bits]).astype(np.int64)
    values += {8: 0, 16: 1 << 15, 32: 1 << 31}[bits]
    return values


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for image_id, width, bits, data in zip(*[batch.column(c) for c in ("image_id", "width", "bits", "data")], strict=True):
            values = samples(data.as_buffer(), bits.as_py())
            wide = width.as_py()
            for at in range(0, len(values), 1 << 18):
                v = values[at : at + (1 << 18)]
                place = np.arange(at, at + len(v))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), image_id.as_py())), pa.array(place % wide), pa.array(place // wide), pa.array(v)], ["image_id", "x", "y", "v"])


def decode_pixels(pictures: DataFrame) -> DataFrame:
    """image_id, x, y, v of every pixel. ``pictures``: image_id, width, bits, data; those without data have none."""
    rows = pictures.filter("data is not null").select("image_id", F.col("width").cast("long").alias("width"), F.col("bits").cast("int").alias("bits"), "data")
    return rows.mapInArrow(_decode, "image_id long, x long, y long, v long")


def display_level(v: Value, bits: Value) -> Column:
    """A decoded sample (16-bit ones moved up, so that the least is 0) as a level of 0 to 255."""
    return F.when(col(bits) == 8, col(v)).otherwise(F.floor((col(v) * 255 + 32895) / 65536)).cast("int")


def _star_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            stars = _star_list(content.as_py())
            if stars is not None:
                n = len(stars)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.arange(n))] + [pa.array(stars[:, i]) for i in range(3)], ["path", "star_id", "x", "y", "mag"])


def _star_list(content: bytes) -> np.ndarray | None:
    """Rows of the first extension if it is a table of exactly three floats."""

    def header(at: int) -> tuple[dict[str, str], int]:
        found: dict[str, str] = {}
        while at + RECORD <= len(content):
            record = content[at : at + RECORD].decode("latin-1")
            at += RECORD
            if record[:8].strip() == "END":
                break
            found[record[:8].strip()] = record[9:].split("/")[0].strip().strip("'").strip()
        return found, -(-at // BLOCK) * BLOCK

    if content[:8] != b"SIMPLE  ":
        return None
    primary, at = header(0)
    table, data = header(at)
    forms = [v for k, v in table.items() if k.startswith("TFORM")]
    wanted = primary.get("NAXIS") == "0" and table.get("XTENSION") == "BINTABLE" and table.get("TFIELDS") == "3"
    if not wanted or any(f not in ("E", "1E") for f in forms):
        return None
    return np.frombuffer(content, ">f4", 3 * int(table["NAXIS2"]), data).reshape(-1, 3).astype(np.float32)


def read_star_lists(spark: SparkSession, path: str) -> DataFrame:
    """path, star_id, x, y, brightness, size from binary tables of x, y and magnitude. Brightness
    only has to order the stars: 1,000,000 less 10,000 for each magnitude, truncated."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(_star_lists, "path string, star_id long, x float, y float, mag float")
    brightness = F.floor((F.lit(1_000_000).cast("float") - F.col("mag") * F.lit(10_000).cast("float")).cast("float")).cast("long")
    return rows.select("path", "star_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), brightness.alias("brightness"), F.lit(1e0).alias("size"))
