"""Partitioned star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.cells import assign_cells
from ..storage import new_folder


def write_stars(stars: DataFrame, folder: str | None = None) -> str:
    """Stars by sky cell, one file for each cell and task range; returns the folder. Dense cells
    are split over several files by star_id, so that no task writes more than its share."""
    folder = folder or new_folder(stars.sparkSession, "stars")
    placed = assign_cells(stars)
    placed.hint("rebalance", "cell_id").write.partitionBy("cell_id").parquet(folder)
    return folder
