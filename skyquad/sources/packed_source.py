"""Packed cell files as a Spark data source that reads only the byte ranges a query asks for.

``spark.dataSource.register(PackedQuads)``, then ``spark.read.format("packed_quads").load(folder)``: columns of
an index's quads. A partition is one pass of one cell, whose subcells lie one after the other in the cell's
file, so it is one range of bytes. Conditions on ``cell_id`` and ``pass`` (equality, IN, ranges) choose the
partitions while the query is planned: files of other cells aren't opened. Conditions on ``r0`` are applied to
the decoded column before the others are decoded. Spark hands conditions over if
``spark.sql.python.filterPushdown.enabled`` is set; without it they are applied after the scan.

Files are opened through pyarrow, by the scheme of the folder (local, s3, hdfs, ...). Index files are read
by the planner; they hold some bytes for each subcell.
"""

from __future__ import annotations

import posixpath
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import datasource as ds

from ..functions.ratios import NAMES
from .packed_index import DATA_VERSION, PASSES_APART, RECORD, descriptors, records

SCHEMA = "cell_id string, pass int, subcell int, pos long, r0 float, r1 float, r2 float, r3 float, r4 float, largest float, mid_ra float, mid_dec float"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_AT_ONCE = 1 << 16  # quads decoded at once


@dataclass
class Range(ds.InputPartition):
    """A pass of a cell: where its bytes are, and its subcells with their numbers of quads."""

    path: str
    little: bool
    cell_id: str
    number: int
    begin: int  # behind the header of the cell's file
    subcells: list[tuple[int, int]]

    @property
    def n_quads(self) -> int:
        return sum(n for _, n in self.subcells)


def ranges(folder: str) -> list[Range]:
    """All passes of all cells, in the order of index files, cells and passes."""
    store, root = fs.FileSystem.from_uri(folder) if re.match(r"[a-z0-9]+:", folder) else (fs.LocalFileSystem(), folder)
    names = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".qdbindex"))
    if not names:
        raise ValueError(f"no packed index in {folder}")
    found: dict[tuple, Range] = {}
    for i, name in enumerate(names):
        with store.open_input_stream(name) as file:
            content = file.read()
        for little, file_name, cell_id, number, _, _, subcell, _, _, offset, n in descriptors(content):
            key = (file_name, number)
            if key not in found:
                found[key] = Range(posixpath.join(folder, file_name), little, cell_id, number + i * PASSES_APART, offset, [])
            found[key].subcells.append((subcell, n))
    return list(found.values())


def _holds(condition: ds.Filter, value) -> bool:
    kind = type(condition)
    if kind is ds.In:
        return value in condition.value
    return {
        ds.EqualTo: lambda a, b: a == b, ds.EqualNullSafe: lambda a, b: a == b, ds.GreaterThan: lambda a, b: a > b,
        ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b,
    }[kind](value, condition.value)


_KNOWN = (ds.In, ds.EqualTo, ds.EqualNullSafe, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)


class _Reader(ds.DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.on_ranges, self.on_ratio = folder, [], []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            name = f.attribute if isinstance(f, _KNOWN + (ds.IsNotNull,)) else None
            if isinstance(f, ds.IsNotNull) and len(name) == 1 and name[0] in _NAMES:
                continue  # no column has nulls
            if isinstance(f, _KNOWN) and name in (("cell_id",), ("pass",)):
                self.on_ranges.append(f)
            elif isinstance(f, _KNOWN[3:]) and name == ("r0",):
                self.on_ratio.append(f)
                yield f  # Spark compares once more, in its own precision
            else:
                yield f

    def partitions(self) -> list[Range]:
        own = {"cell_id": lambda r: r.cell_id, "pass": lambda r: r.number}
        return [r for r in ranges(self.folder) if r.n_quads and all(_holds(f, own[f.attribute[0]](r)) for f in self.on_ranges)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no range is left
            return
        store, path = fs.FileSystem.from_uri(partition.path) if re.match(r"[a-z0-9]+:", partition.path) else (fs.LocalFileSystem(), partition.path)
        subcell = np.repeat([s for s, _ in partition.subcells], [n for _, n in partition.subcells]).astype(np.int32)
        pos = np.concatenate([np.arange(n) for _, n in partition.subcells])
        with store.open_input_file(path) as file:
            head = re.match(rb"[A-Z]+", file.read(256))
            file.seek(head.end() if head else 0)
            if head is None or struct.unpack("<i" if partition.little else ">i", file.read(4))[0] != DATA_VERSION:
                raise ValueError(f"not a packed cell file of version {DATA_VERSION}: {path}")
            file.seek(head.end() + 4 + partition.begin)
            for at in range(0, len(pos), _AT_ONCE):
                n = min(_AT_ONCE, len(pos) - at)
                data = np.frombuffer(file.read(n * RECORD), np.uint8).reshape(-1, RECORD)
                if len(data) < n:
                    raise ValueError(f"{path} is too short")
                keep = np.arange(n)
                if self.on_ratio:
                    first = records(data.tobytes(), partition.little, only="r0")["r0"].astype(np.float64)
                    # A step of single precision either way: what is exactly right, Spark decides.
                    keep = np.flatnonzero(np.all([_near(f, first) for f in self.on_ratio], axis=0))
                if len(keep):
                    found = records(data[keep].tobytes(), partition.little)
                    own = {"cell_id": pa.array([partition.cell_id] * len(keep)), "pass": pa.array(np.full(len(keep), partition.number, dtype=np.int32)), "subcell": pa.array(subcell[at + keep]), "pos": pa.array(pos[at + keep])}
                    yield pa.RecordBatch.from_arrays([own[c] if c in own else pa.array(found[c]) for c in _NAMES], _NAMES)


def _near(condition: ds.Filter, values: np.ndarray) -> np.ndarray:
    slack = 1e-6
    return values > condition.value - slack if isinstance(condition, (ds.GreaterThan, ds.GreaterThanOrEqual)) else values < condition.value + slack


class PackedQuads(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_quads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ds.DataSourceReader:
        return _Reader(self.options["path"])


assert len(_NAMES) == 4 + len(NAMES) + 3
