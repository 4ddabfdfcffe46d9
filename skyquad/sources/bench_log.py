"""Console output of a solve: a JSON object, then lines of stage durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import Value, col

#: Names of the stages as they are printed, and of the result's keys.
STAGES = {"image_read": "IMAGEREAD", "star_detection": "STARDETECTION", "quad_formation": "QUADFORMATION", "solve": "SOLVE"}
RESULT = (
    "success boolean, ra double, dec double, fieldRadius double, starsDetected int, starsUsed int, searchIterations int, quadMatches int, "
    "searchRunCenter string, searchRunRadius double, timeSpent string, imageWidth int, imageHeight int"
)


def duration(output: Value, stage: str) -> Column:
    return F.regexp_extract(col(output), rf"(?m)^\s*{STAGES[stage]}_DURATION\w*:\s*([0-9.eE+-]+)\s*$", 1).try_cast("double")


def parse_output(runs: DataFrame, output: str = "output") -> DataFrame:
    """Adds a column ``result`` and one per stage duration; null where the output lacks them."""
    text = F.regexp_extract(F.col(output), r"(?s)(\{.*\n?\s*\})", 1)
    return runs.withColumn("result", F.from_json(text, RESULT)).withColumns({s: duration(output, s) for s in STAGES})
