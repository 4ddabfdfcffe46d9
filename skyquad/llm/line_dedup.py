"""Line deduplication over all documents, with DataFrame functions only.

Lines (split at ``\\n``) are exploded with their positions. A line's key is the line without ASCII
white space at both ends and with A-Z lower-cased, hashed to 128 bits. Keys of ``LEAST_CHARS`` code
points or more that ``LEAST_DOCUMENTS`` documents hold lose all their lines, except those of the
smallest doc_id that holds them. The positions of the lines that go are gathered per document, and
what lies between them is put together again in its order.

Keys are reduced to one row, by partial aggregates, before lines are joined to them, so a line that
very many documents share is never gathered. What is joined are written tables on both sides, so
that the rows of a hot key can be split. No text moves but in the last join, once.

Rules: a null or empty text is one empty line. Rows that share a doc_id are one document; each of
them is returned with its own lines. Rows without doc_id are together one document, after all
others. A document from which every line goes has the empty text. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, whole_text

LEAST_CHARS = 10
LEAST_DOCUMENTS = 2
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, copy (tells texts of one doc_id apart), lines."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("copy"), F.split("text", "\n", -1).alias("lines"))


def _long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, copy, place, h1, h2 of the lines whose keys are long enough to be looked at."""
    lines = _rows(docs).select("doc_id", "copy", F.posexplode("lines").alias("place", "line"))
    lines = lines.select("doc_id", "copy", "place", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= least_chars)
    return lines.select("doc_id", "copy", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def repeated_keys(lines: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """h1, h2 and the first document of the keys that so many documents hold."""
    bounds = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("unnamed"))
    # Two documents or more: different ids, or one and rows without.
    several = bounds.filter("first <> last or (unnamed > 0 and first is not null)").select("h1", "h2", "first")
    if least_documents <= 1:
        return bounds.select("h1", "h2", "first")
    if least_documents == 2:
        return several
    several = stash(several, "shared-keys")
    counts = lines.join(several.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").count()
    return several.join(counts.filter(F.col("count") >= least_documents).select("h1", "h2"), ["h1", "h2"])


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, text (of the lines that stay), n_lines (before), n_dropped: one row per row of ``docs``."""
    lines = _long_lines(docs, least_chars)
    keys = stash(repeated_keys(lines, least_documents), "line-keys")
    gone = lines.join(keys, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    gone = gone.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_set("place")).alias("gone"))
    gone = stash(gone.select(F.col("doc_id").alias("of"), F.col("copy").alias("of_copy"), "gone"), "gone-lines")
    rows = _rows(docs)
    found = rows.join(gone, rows["doc_id"].eqNullSafe(gone["of"]) & (rows["copy"] == gone["of_copy"]), "left")
    # Between two lines that go lies a slice that stays, which may be empty: linear in the lines.
    starts, ends = F.concat(F.array(F.lit(0)), F.transform("gone", lambda i: i + 1)), F.concat("gone", F.array(F.size("lines")))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: F.slice("lines", s["a"] + 1, s["b"] - s["a"])))
    return found.select(
        "doc_id",
        F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept), "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
