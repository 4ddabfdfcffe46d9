"""PNG and JPEG pictures as gray samples in the form that ``fits.decode_pixels`` reads."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import Value, col

_PICTURE = "path string, width long, height long, bits int, data binary, error string"
#: BT.601 luma weights.
LUMA = (0.299, 0.587, 0.114)


def image_format(content: Value) -> Column:
    """'png', 'jpeg', 'fits' or null, by the first bytes."""
    start = F.hex(F.substring(col(content), 1, 8))
    return F.when(start == "89504E470D0A1A0A", "png").when(start.startswith("FFD8FF"), "jpeg").when(start == "53494D504C452020", "fits")


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Undoes the five PNG row filters. Three of them are sums over whole rows; where a picture has any of the
    other two, in which a byte needs those to its left, above and between, it is undone by diagonals."""
    rows = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    kinds, wide = rows[:, 0], -(-stride // step)
    if kinds.size and kinds.max() > 4:
        raise ValueError(f"unknown row filter {kinds.max()}")
    lines = np.zeros((height, wide * step), dtype=np.uint8)
    lines[:, :stride] = rows[:, 1:]
    if np.isin(kinds, (3, 4)).any():
        return _by_diagonals(kinds, lines.reshape(height, wide, step)).reshape(height, -1)[:, :stride]
    above = np.zeros(wide * step, dtype=np.uint8)
    for y in range(height):
        if kinds[y] == 1:
            lines[y] = np.cumsum(lines[y].reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kinds[y] == 2:
            lines[y] += above
        above = lines[y]
    return lines[:, :stride]


def _by_diagonals(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """All bytes at which column and row have one sum need only those of the two sums before: they
    are undone together. Bytes of a diagonal lie ``wide - 1`` apart."""
    height, wide, step = lines.shape
    if wide == 1:  # one column is one more with nothing to its right
        return _by_diagonals(kinds, np.concatenate([lines, np.zeros_like(lines)], axis=1))[:, :1]
    flat, out = lines.reshape(-1, step), np.zeros((height * wide, step), dtype=np.uint8)
    kind = kinds.astype(np.int16)[:, None]
    by = [kind == k for k in range(5)]
    # Of the diagonals before: a value for each row, behind one of zeros for what is above the first.
    before, older = np.zeros((height + 1, step), dtype=np.int16), np.zeros((height + 1, step), dtype=np.int16)
    for d in range(wide + height - 1):
        top, end = max(0, d - wide + 1), min(height, d + 1)
        at = slice(d + top * (wide - 1), d + (end - 1) * (wide - 1) + 1, wide - 1)
        left, up, corner = before[top + 1 : end + 1], before[top:end], older[top:end]
        by_left, by_up, by_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))
        guess = np.select([b[top:end] for b in by[1:]], [left, up, (left + up) >> 1, nearest], 0)
        now = older.copy()
        now[top + 1 : end + 1] = (flat[at] + guess) & 255
        out[at] = now[top + 1 : end + 1]
        before, older = now, before
    return out.reshape(height, wide, step)


#: Fixed values of interlaced PNG: first column and row of each pass, and the steps between them.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _samples(raw: bytes, width: int, height: int, channels: int, bits: int) -> tuple[np.ndarray, int]:
    """(height, width, channels) samples, and the bytes they took."""
    stride = -(-width * channels * bits // 8)
    rows = _unfilter(raw, height, stride, max(1, channels * bits // 8))
    if bits == 16:
        values = np.ascontiguousarray(rows).view(">u2").astype(np.uint16)
    elif bits == 8:
        values = rows
    else:
        values = np.unpackbits(rows, axis=1).reshape(height, -1, bits) @ (1 << np.arange(bits)[::-1])
    return values[:, : width * channels].reshape(height, width, channels), height * (stride + 1)


def decode_png(content: bytes) -> tuple[int, int, int, bytes]:
    """(width, height, bits, big-endian gray samples) of 8 or 16 bits, signed where 16. Palettes,
    interlacing and depths under 8 bits (stretched to 8) are read. ValueError for what isn't a PNG."""
    at, head, packed, palette = 8, None, [], None
    while at + 8 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.float64)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or not packed:
        raise ValueError("no header or no pixels")
    width, height, bits, color, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if channels is None or bits not in (1, 2, 4, 8, 16) or color == 3 and palette is None:
        raise ValueError(f"color type {color} of {bits} bits")
    raw, samples = zlib.decompress(b"".join(packed)), np.zeros((height, width, channels), dtype=np.uint16)
    for x, y, dx, dy in _PASSES if interlaced else ((0, 0, 1, 1),):
        wide, high = -(-(width - x) // dx), -(-(height - y) // dy)
        if wide > 0 and high > 0:
            samples[y::dy, x::dx], used = _samples(raw, wide, high, channels, bits)
            raw = raw[used:]
    if color == 3:
        samples, channels, bits = palette[samples[..., 0]], 3, 8
    elif bits < 8:
        samples, bits = samples * (255 // ((1 << bits) - 1)), 8
    samples = samples.astype(np.float64)
    gray = samples[..., 0] if channels < 3 else np.rint(samples[..., :3] @ np.array(LUMA))
    if bits == 8:
        return width, height, 8, gray.astype(np.uint8).tobytes()
    return width, height, 16, (gray - 32768).astype(">i2").tobytes()


def _pngs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            try:
                found = (*decode_png(content.as_py()), None)
            except (ValueError, IndexError, struct.error, zlib.error) as e:
                found = (None, None, None, None, f"PNG: {e}")
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((path, *found), kinds, strict=True)], ["path", "width", "height", "bits", "data", "error"])


def png_pictures(files: DataFrame) -> DataFrame:
    """``files``: path and content. One row for each PNG file; those that can't be read have an error."""
    return files.filter(image_format("content") == "png").select("path", "content").mapInArrow(_pngs, _PICTURE)


def read_png(spark: SparkSession, path: str) -> DataFrame:
    return png_pictures(spark.read.format("binaryFile").load(path))


def _grays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, width, height, channels, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            samples = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
            gray = samples[..., 0] if channels < 3 else np.rint(samples[..., 2::-1] @ np.array(LUMA))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([width], pa.int64()), pa.array([height], pa.int64()), pa.array([8], pa.int32()), pa.array([gray.astype(np.uint8).tobytes()], pa.binary()), pa.array([None], pa.string())], ["path", "width", "height", "bits", "data", "error"])


def _jpegs(images: DataFrame) -> DataFrame:
    """Spark's own image source decodes the files; those it can't read have an error."""
    images = images.select(plain_path(F.col("image.origin")).alias("origin"), "image.width", "image.height", "image.nChannels", "image.data")
    good = images.filter("nChannels > 0").mapInArrow(_grays, _PICTURE)
    bad = images.filter("nChannels <= 0").select(F.col("origin").alias("path"), F.lit("JPEG: not readable").alias("error"))
    return good.unionByName(bad, allowMissingColumns=True)


def plain_path(path: Column) -> Column:
    """Local paths with one slash, as file sources name them."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def read_jpeg(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """By name."""
    return _jpegs(spark.read.format("image").option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG}").load(path))


def jpeg_pictures(spark: SparkSession, path: str | list[str], files: DataFrame) -> DataFrame:
    """By content: those of ``files`` (path, content) that are JPEG, whatever their names. Files of other
    names are decoded only if there are any."""
    named = F.lower("path").rlike(r"\.jpe?g$")
    found = read_jpeg(spark, path)
    kinds = files.select(plain_path(F.col("path")).alias("path"), image_format("content").alias("kind"))
    # A file called JPEG that is something else is that, or nothing.
    found = found.join(kinds.filter("kind in ('png', 'fits')"), "path", "left_anti")
    others = kinds.filter((F.col("kind") == "jpeg") & ~named).select("path")
    if others.isEmpty():
        return found
    images = spark.read.format("image").load(path)
    wanted = images.join(others, plain_path(F.col("image.origin")) == others["path"], "left_semi")
    return found.unionByName(_jpegs(wanted))
