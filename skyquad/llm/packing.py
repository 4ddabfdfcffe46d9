"""Sequence packing: bounded-space best-fit per partition, then a merge of the leftovers.

Each input partition is tokenized and packed where it lies, without a shuffle. A document longer
than a window fills windows of its own; what is left of it goes into the open window that it
fills best. ``OPEN`` windows stay open; if none fits, the fullest is emitted and a new one opened.
The open windows left at the end of every partition, at most ``OPEN`` each, are then dealt into
groups of about ``GROUP`` windows and packed into one another, largest first, so that padding
doesn't grow with the number of partitions. Only descriptions of pieces are shuffled, and no id.

Rules: a null text counts as empty; every document ends with ``end_id``, so an empty one is a
piece of one id. A document is cut only where it is longer than a window. Rows that repeat a
doc_id are packed as documents of their own. Sequences are padded to the window, except those
whose length is a power of two. Texts may be of any length and hold runs of any characters; a task
holds the ids of one text at a time. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe
from .common import stash, whole_text

WINDOW = 1024
OPEN = 32
GROUP = 4096
END_ID = 0
_MERGED = 1 << 62  # sequence ids of merged windows lie above those of the partitions
_SHIFT = 32

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, window long, offset long, closed boolean"


class OpenWindows:
    """At most ``limit`` windows of ``size``; items are placed best-fit."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit, self.next = size, limit, 0
        self.free: list[tuple[int, int]] = []  # (room, window), sorted

    def place(self, length: int) -> tuple[int, int, int | None]:
        """(window, offset there, window that had to be emitted first)."""
        emitted = None
        at = bisect.bisect_left(self.free, (length, -1))
        if at == len(self.free):
            if len(self.free) >= self.limit:
                emitted = self.free.pop(0)[1]
            room, window = self.size, self.next
            self.next += 1
        else:
            room, window = self.free.pop(at)
        if room > length:
            bisect.insort(self.free, (room - length, window))
        return window, self.size - room, emitted


def _packer(vocabulary: str, end_id: int, size: int, limit: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = byte_bpe.load(vocabulary), TaskContext.get().partitionId()
        windows, end = OpenWindows(size, limit), np.array([end_id], dtype=np.uint32)
        waiting: dict[int, list[tuple]] = {}  # pieces of windows that are still open
        names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids

        def rows(found: list[tuple], closed: bool) -> pa.RecordBatch:
            columns = list(zip(*[(*p[:5], part, *p[5:7], closed, *p[7:]) for p in found], strict=True))
            kinds = [pa.int64()] * 8 + [pa.bool_()] + [pa.binary()] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            done: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.concatenate([tokens.encode(text.as_py()), end]).astype("<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    window, offset, emitted = windows.place(len(piece))
                    row = (doc_id, start, len(piece), zlib.crc32(piece), len(ids), window, offset)
                    if emitted is not None:
                        done += waiting.pop(emitted)
                    waiting.setdefault(window, []).append((*row, piece.tobytes()) if with_ids else row)
                    if offset + len(piece) == size:
                        done += waiting.pop(window)
            if done:
                yield rows(done, True)
        left = [p for pieces in waiting.values() for p in pieces]
        if left:
            yield rows(left, False)

    return run


def _merge(size: int):
    def run(key: tuple, windows: pd.DataFrame) -> pd.DataFrame:
        """Packs the windows of a group into one another, largest first."""
        windows = windows.sort_values(["used", "part", "window"], ascending=[False, True, True])
        packed = OpenWindows(size, len(windows))
        base = _MERGED + (int(key[0]) << _SHIFT)
        placed = [packed.place(int(n))[:2] for n in windows["used"]]
        return pd.DataFrame(
            {
                "part": windows["part"],
                "window": windows["window"],
                "sequence_id": [base + w for w, _ in placed],
                "shift": [o for _, o in placed],
            }
        )

    return run


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    open_windows: int = OPEN,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    if asked for, the ids themselves (little-endian unsigned 32-bit)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    run = _packer(vocabulary or byte_bpe.default_path(), end_id, window, open_windows, with_ids)
    pieces = stash(rows.mapInArrow(run, PIECES + ", ids binary" * with_ids), "pieces")
    left = pieces.filter(~F.col("closed")).groupBy("part", "window").agg(F.sum("length").alias("used"))
    groups = -(-left.count() // GROUP) or 1
    left = left.withColumn("group", F.pmod(F.xxhash64("part", "window"), F.lit(groups)))
    merged = left.groupBy("group").applyInPandas(_merge(window), "part long, window long, sequence_id long, shift long")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    full = pieces.filter("closed").withColumn("sequence_id", F.shiftleft("part", _SHIFT) + F.col("window"))
    moved = pieces.filter(~F.col("closed")).join(merged, ["part", "window"]).withColumn("offset", F.col("offset") + F.col("shift"))
    return full.select(out).unionByName(moved.select(out))
