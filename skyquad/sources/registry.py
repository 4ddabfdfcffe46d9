"""Which reader takes a file, by its extension."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

Reader = Callable[[SparkSession, str], DataFrame]
_READERS: dict[str, Reader] = {}
_OWN: set[str] = set()


def register_reader(reader: Reader, *extensions: str) -> None:
    """Extensions are compared without regard to case; taking one twice is an error."""
    for e in (x.lower().lstrip(".") for x in extensions):
        if e in _READERS:
            raise ValueError(f"there is a reader for .{e} already")
        _READERS[e] = reader
        _OWN.add(e)


def unregister_reader(*extensions: str) -> None:
    for e in extensions:
        _READERS.pop(e.lower().lstrip("."), None)
        _OWN.discard(e.lower().lstrip("."))


def own_readers() -> dict[str, Reader]:
    """Readers that were registered, by extension, without those for FITS, PNG and JPEG that come with
    the library."""
    return {e: r for e, r in _READERS.items() if e in _OWN}


def reader_for(path: str) -> Reader:
    from . import fits, raster

    for reader, names in ((fits.read_fits, ("fit", "fits")), (raster.read_png, ("png",)), (raster.read_jpeg, ("jpg", "jpeg"))):
        for n in names:
            _READERS.setdefault(n, reader)
    extension = PurePosixPath(path).suffix.lower().lstrip(".")
    if extension not in _READERS:
        raise ValueError(f"no reader for .{extension}")
    return _READERS[extension]
