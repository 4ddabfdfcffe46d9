"""FITS headers with the world coordinates of a solution, built from column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import Value, col

RECORD, BLOCK = 80, 2880
DIGITS = 13


def number_text(value: Value) -> Column:
    """Up to 13 significant digits, without trailing zeros; scientific from 1e13 and below 1e-4,
    with an exponent of at least two digits."""
    value = col(value).cast("double")
    raw = F.format_string(f"%.{DIGITS - 1}e", F.abs(value))
    power = F.regexp_extract(raw, r"e([+-]\d+)$", 1).cast("int")
    digits = F.regexp_replace(F.regexp_extract(raw, r"^(\d\.\d+)e", 1), r"\.", "")
    whole = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(DIGITS)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    fixed = F.regexp_replace(F.when(power >= 0, whole).otherwise(small), r"\.?0+$", "")
    mantissa = F.regexp_replace(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, DIGITS)), r"\.?0+$", "")
    scientific = F.concat(mantissa, F.lit("E"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    shown = F.when((power > -5) & (power < DIGITS), fixed).otherwise(scientific)
    return F.when(value == 0, F.lit("0")).otherwise(F.concat(F.when(value < 0, "-").otherwise(""), shown))


def _record(keyword: str, value: Column, comment: str | None) -> Column:
    text = F.concat(value, F.lit(f" / {comment}")) if comment is not None else value
    return F.concat(F.lit(f"{keyword:<8}"[:8] + "= "), F.rpad(F.substring(text, 1, 70), 70, " "))


def number_record(keyword: str, value: Value, comment: str | None = None) -> Column:
    return _record(keyword, F.lpad(number_text(value), 20, " "), comment)


def plain_record(keyword: str, value: Value, comment: str | None = None) -> Column:
    """Whole numbers and single characters, right-aligned; null gives spaces."""
    text = F.lpad(col(value).cast("string"), 20, " ")
    return _record(keyword, F.coalesce(text, F.lit(" " * 70)), comment)


def text_record(keyword: str, value: Value, comment: str | None = None) -> Column:
    value = col(value)
    padded = F.when(F.length(value) < 8, F.rpad(value, 8, " ")).otherwise(value)
    return _record(keyword, F.concat(F.lit("'"), padded, F.lit("'")), comment)


def comment_record(comment: Value) -> Column:
    return F.rpad(F.substring(F.concat(F.lit("COMMENT "), col(comment)), 1, RECORD), RECORD, " ")


def end_record() -> Column:
    return F.lit("END".ljust(RECORD))


def wcs_records() -> Column:
    """The records of a solution, in order (columns of a solution). Order and comments are fixed."""
    return F.array(
        plain_record("SIMPLE", F.lit("T"), "Standard FITS file"),
        plain_record("BITPIX", F.lit("8"), "no real data"),
        plain_record("NAXIS", F.lit("0"), "no real data"),
        plain_record("EXTEND", F.lit("T"), "no comment"),
        plain_record("WCSAXES", F.lit("2"), "ra and dec"),
        text_record("CTYPE1", F.lit("RA---TAN"), "linear"),
        text_record("CTYPE2", F.lit("DEC--TAN"), "linear"),
        plain_record("EQUINOX", F.lit(2000), "Equatorial coords definition year"),
        number_record("LONPOLE", F.lit(180e0), "no comment"),
        number_record("LATPOLE", F.lit(0e0), "no comment"),
        number_record("CRVAL1", "crval1", "RA of reference pixel"),
        number_record("CRVAL2", "crval2", "DEC of reference pixel"),
        number_record("CRPIX1", "crpix1", "X of reference pixel"),
        number_record("CRPIX2", "crpix2", "Y of reference pixel"),
        text_record("CUNIT1", F.lit("deg"), "degrees"),
        text_record("CUNIT2", F.lit("deg"), "degrees"),
        *[number_record(f"CD{i}_{j}", f"cd{i}_{j}", "cd matrix") for i in (1, 2) for j in (1, 2)],
        plain_record("IMAGEW", "width", "Image width in pixels"),
        plain_record("IMAGEH", "height", "Image height in pixels"),
        comment_record(F.lit("WCS header of a plate solution")),
        end_record(),
    )


def wcs_files(solutions: DataFrame) -> DataFrame:
    """image_id and content: a header padded to whole blocks."""
    text = F.array_join(wcs_records(), "")
    size = (F.ceil(F.length(text) / BLOCK) * BLOCK).cast("int")
    return solutions.select("image_id", F.encode(F.rpad(text, size, " "), "US-ASCII").alias("content"))
