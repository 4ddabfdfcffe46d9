"""Packed index files of earlier releases as an index of tables: descriptors, cell files, 18-byte records.

An index file (``*.qdbindex``) begins with letters that end in INDEX, a version byte and a byte that
is 1 for little-endian data. A descriptor of each cell file follows: its name (with a length byte), band,
cell and number of passes, and for each pass its density, divisions and number of subcells, each of
these with the position of its center and the length of its data. A cell file begins with letters and
its version; the data of all subcells follow one after the other. Cell files are read whole, one at a
time for each task.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..functions.base import narrow
from ..functions.ratios import BITS, NAMES
from ..functions.sphere import angular_distance
from ..operators.index import Index

#: Fixed values of the format.
INDEX_VERSION, DATA_VERSION, RECORD = 1, 3, 18
_SUBCELLS = "path string, little boolean, file string, cell_id string, pass int, density float, divisions int, subcell int, center_ra float, center_dec float, data_offset long, n_quads long"
_QUADS = "cell_id string, pass int, subcell int, pos long, r0 float, r1 float, r2 float, r3 float, r4 float, largest float, mid_ra float, mid_dec float"
PASSES_APART = 1000  # numbers between the passes of two index files


def descriptors(content: bytes) -> Iterator[tuple]:
    """(little, file, cell_id, pass, density, divisions, subcell, center_ra, center_dec, data_offset,
    n_quads) of all subcells. The offset counts from the end of a cell file's header."""
    head = re.match(rb"[A-Z]+INDEX(.)(.)", content, re.S)
    if head is None or head[1][0] != INDEX_VERSION:
        raise ValueError(f"not a packed index of version {INDEX_VERSION}")
    little = head[2][0] == 1
    order, at = "<" if little else ">", head.end()

    def take(form: str) -> tuple:
        nonlocal at
        found = struct.unpack_from(order + form, content, at)
        at += struct.calcsize(order + form)
        return found

    while at < len(content):
        (length,) = take("B")
        name = content[at : at + length].decode("utf-8")
        at += length
        band, cell, n_passes = take("iii")
        offset = 0
        for number in range(n_passes):
            density, divisions, n = take("fii")
            for subcell in range(n):
                ra, dec, size = take("ffi")
                yield little, name, f"b{band:02d}c{cell:02d}", number, density, divisions, subcell, ra, dec, offset, size // RECORD
                offset += size


def records(data: bytes, little: bool = True, only: str | None = None) -> dict[str, np.ndarray]:
    """r0..r4, largest, mid_ra, mid_dec of packed quads: six bytes of ratios, lowest bits first in any byte
    order, and three floats; or one of the ratios."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, RECORD)
    packed = (rows[:, :6].astype(np.int64) << (8 * np.arange(6))).sum(axis=1)
    out, shift = {}, 0
    for name, bits in zip(NAMES, BITS, strict=True):
        top = (1 << bits) - 1
        if only in (None, name):
            out[name] = ((packed >> shift) & top).astype(np.float32) * np.float32(1.0 / top)
        shift += bits
    if only is not None:
        return out
    floats = np.ascontiguousarray(rows[:, 6:]).view("<f4" if little else ">f4").astype(np.float32)
    return out | {"largest": floats[:, 0], "mid_ra": floats[:, 1], "mid_dec": floats[:, 2]}


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _read_descriptors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.float32(), pa.int32(), pa.int32(), pa.float32(), pa.float32(), pa.int64(), pa.int64())
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows = [(path, *d) for d in descriptors(content.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _names(_SUBCELLS))


def _read_quads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content, parts in zip(batch.column("content"), batch.column("parts").to_pylist(), strict=True):
            data = content.as_buffer()
            head = re.match(rb"[A-Z]+", data)
            little = parts[0]["little"]
            if head is None or struct.unpack_from("<i" if little else ">i", data, head.end())[0] != DATA_VERSION:
                raise ValueError(f"not a packed cell file of version {DATA_VERSION}: {parts[0]['file']}")
            for p in parts:
                begin, n = head.end() + 4 + p["data_offset"], p["n_quads"]
                found = records(memoryview(data)[begin : begin + n * RECORD], little)
                own = {"cell_id": pa.array([p["cell_id"]] * n, pa.string()), "pass": pa.array(np.full(n, p["pass"]), pa.int32()), "subcell": pa.array(np.full(n, p["subcell"]), pa.int32()), "pos": pa.array(np.arange(n))}
                yield pa.RecordBatch.from_arrays([own[c] if c in own else pa.array(found[c]) for c in _names(_QUADS)], _names(_QUADS))


def read_packed_index(spark: SparkSession, folder: str, by_ranges: bool = False) -> Index:
    """All packed indexes of a folder as one: passes of several index files make one ladder. The folder
    must hold an index file; a cell file that is named but missing is an error. ``by_ranges``: quads are
    read by ``packed_source``, so that a search opens only the cells and passes of its area; the
    folder must then be one that pyarrow can open."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.qdbindex").load(folder)
    paths = sorted(r.path for r in found.select("path").collect())  # a handful of index files
    if not paths:
        raise ValueError(f"no packed index in {folder}")
    number = F.create_map(*[F.lit(v) for i, p in enumerate(paths) for v in (p, i * PASSES_APART)])
    cells = found.select("path", "content").mapInArrow(_read_descriptors, _SUBCELLS)
    cells = cells.withColumn("pass", (F.col("pass") + F.element_at(number, F.col("path"))).cast("int"))
    own = ["little", "file", "cell_id", "pass", "subcell", "data_offset", "n_quads"]
    parts = cells.groupBy("file").agg(F.collect_list(F.struct(*own)).alias("parts"))  # a cell's some thousand subcells
    named = {PurePosixPath(r.file).name for r in cells.select("file").distinct().collect()}  # 406 for each index file at most
    files = spark.read.format("binaryFile").load(folder).withColumn("file", F.element_at(F.split("path", "/"), -1))
    there = {r.file for r in files.select("file").collect()}
    if named - there:
        raise ValueError(f"cell files are missing: {', '.join(sorted(named - there)[:5])}")
    if by_ranges:
        from .packed_source import PackedQuads

        spark.dataSource.register(PackedQuads)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        quads = spark.read.format("packed_quads").load(folder)
    else:
        quads = files.join(parts, "file").select("content", "parts").mapInArrow(_read_quads, _QUADS)
    subcells = cells.select("cell_id", "pass", "subcell", "center_ra", "center_dec", "n_quads")
    before = Window.partitionBy("cell_id").orderBy("pass", "subcell").rowsBetween(Window.unboundedPreceding, 0)
    subcells = subcells.withColumn("first_row", F.sum("n_quads").over(before) - F.col("n_quads"))
    center = F.struct("center_ra", "center_dec")
    passes = cells.groupBy("cell_id", "pass").agg(
        F.sum("n_quads").alias("n_quads"), F.first("density").alias("density"), F.first("divisions").alias("divisions"),
        F.min_by(center, "subcell").alias("a"), F.max_by(center, "subcell").alias("b"),
    )
    corners = [F.col(c).cast("double") for c in ("a.center_ra", "a.center_dec", "b.center_ra", "b.center_dec")]
    radius = angular_distance(*corners) / F.nullif(F.col("divisions") - 1, F.lit(0)) / 2
    rank = F.row_number().over(Window.partitionBy("cell_id").orderBy("density", "pass")).cast("int")
    passes = passes.select("cell_id", "pass", "n_quads", narrow(F.col("density")).alias("density"), rank.alias("density_rank"), "divisions", radius.alias("avg_subcell_radius"))
    return Index(quads, passes, subcells)
