"""SimHash near-duplicates through multi-index hashing.

A text is lower-cased (A-Z only), cut into words at ASCII white space and into shingles of
``SHINGLE`` words, repeats included. Each shingle's XXH64 (seed 42) votes for the bits of a 64-bit
fingerprint; a bit is set if more than half of the shingles set it.

Fingerprints at ``DISTANCE`` = 2 or fewer differing bits are linked. Split into two segments of 32
bits, such a pair differs in at most one bit in one of the segments. So each distinct fingerprint
is stored in two tables, one per segment, and looks up the Hamming ball of radius one around each
of its segments; every match is verified on all 64 bits. A ball entry is looked up only from the
side on which the differing bit is unset, so a pair meets once per table. Where many fingerprints
share a segment value, that bucket is split by the other segment's 16-bit halves, again looked up
by their small balls (two bits over two halves leave one half with at most one), so nothing is
capped. Links are between distinct fingerprints only: equal ones are one node.

Rules: a null or empty text has fingerprint zero and is linked like any other. A component's id
is its smallest doc_id; nulls among doc_ids are ignored there. Rows that repeat a doc_id are
fingerprinted each. ``drop_near_duplicates`` keeps one row of each component: that with the smallest
doc_id, rows without one coming last; rows are told apart by doc_id and text, so a repeated doc_id
loses no text. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_marked, stash, text_digest, whole_text
from .components import components

SHINGLE = 3
DISTANCE = 2
SEED = 42
CROWDED = 4096  # fingerprints with one segment value


def fingerprint(text: str) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)], strict=False))
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the unsigned 64-bit hashes set, as a signed integer."""
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):  # a bounded table of bits for very long texts
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fp"])


def _keyed_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(values, pa.int64())], ["key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (signed 64-bit) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _bits(of: Column, width: int) -> Column:
    """``of`` itself, and ``of`` with each of its unset bits set."""
    masks = F.array(*[F.lit(1 << i).cast("long") for i in range(width)])
    unset = F.filter(masks, lambda m: of.bitwiseAND(m) == 0)
    return F.concat(F.array(of), F.transform(unset, lambda m: of.bitwiseOR(m)))


def _ball(of: Column, width: int) -> Column:
    masks = F.array(*[F.lit(0 if i < 0 else 1 << i).cast("long") for i in range(-1, width)])
    return F.transform(masks, lambda m: of.bitwiseXOR(m))


def _halves(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))]


def links(distinct: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Pairs (a, b) of different fingerprints at two or fewer bits. ``distinct``: column fp."""
    high, low = _halves(F.col("fp"))
    tag = F.lit(1 << 32).cast("long")  # tells the tables apart
    stored = distinct.select("fp", F.explode(F.array(high, low.bitwiseOR(tag))).alias("key"))
    looked = distinct.select(
        "fp", F.explode(F.concat(_bits(high, 32), F.transform(_bits(low, 32), lambda v: v.bitwiseOR(tag)))).alias("key")
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    # From the value's own bucket each pair is met from both sides: the smaller one looks up.
    own = F.col("key") == F.when(F.col("key").bitwiseAND(tag) == 0, _halves(F.col("a"))[0]).otherwise(
        _halves(F.col("a"))[1].bitwiseOR(tag)
    )
    once = ~own | (F.col("a") < F.col("b"))
    left = looked.withColumnRenamed("fp", "a")
    right = stored.withColumnRenamed("fp", "b")
    heavy = right.groupBy("key").count().filter(F.col("count") > crowded).select("key")
    heavy = stash(heavy, "crowded")
    if heavy.isEmpty():
        return left.join(right, "key").filter(near & once).select("a", "b").distinct()

    def other(column: str) -> Column:
        h, lo = _halves(F.col(column))
        return F.when(F.col("key").bitwiseAND(tag) == 0, lo).otherwise(h)

    def sub(column: str, ball: bool) -> Column:
        """Keys of the two 16-bit halves of the other segment."""
        upper, lower = F.shiftrightunsigned(other(column), 16), other(column).bitwiseAND(F.lit(0xFFFF))
        keys = [_ball(p, 16) if ball else F.array(p) for p in (upper, lower)]
        return F.concat(keys[0], F.transform(keys[1], lambda v: v.bitwiseOR(F.lit(1 << 16).cast("long"))))

    plain = left.join(heavy, "key", "left_anti").join(right.join(heavy, "key", "left_anti"), "key")
    full = (
        left.join(heavy, "key", "left_semi").select("a", "key", F.explode(sub("a", True)).alias("sub"))
        .join(right.join(heavy, "key", "left_semi").select("b", "key", F.explode(sub("b", False)).alias("sub")), ["key", "sub"])
    )
    pairs = plain.filter(near & once).select("a", "b").unionByName(full.filter(near & once).select("a", "b"))
    return pairs.distinct()


def _rooted(rows: DataFrame) -> DataFrame:
    """fp and root (least fingerprint of its component) of each distinct fingerprint."""
    distinct = stash(rows.select("fp").distinct(), "distinct")
    joined = components(links(distinct))
    return distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row."""
    rows = stash(fingerprints(docs), "fingerprints")
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")).join(_rooted(rows), "fp")
    least = firsts.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = firsts.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Of each component of ``docs`` the row with the smallest doc_id, with its columns."""
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest")).alias("key"), whole_text().alias("text"))
    rows = stash(rows.mapInArrow(_keyed_fingerprints, "key struct<doc_id: long, digest: binary>, fp long").select("key.*", "fp"), "fingerprints")
    marks = stash(rows.groupBy("doc_id", "digest", "fp").agg(F.count(F.lit(1)).alias("n_rows")).join(_rooted(rows), "fp"), "marks")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    marks = marks.join(marks.groupBy("root").agg(first), "root")
    stays = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.digest") == F.col("digest"))
    gone, repeated = marks.filter(~stays), marks.filter(stays & (F.col("n_rows") > 1))
    return drop_marked(docs, gone.select("doc_id", "digest"), repeated.select("doc_id", "digest"))
