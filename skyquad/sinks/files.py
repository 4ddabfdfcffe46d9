"""A file for each picture or job, through Spark's own writers: a folder by key, one file in it. A task's
files appear when the job commits; what a failed or repeated task wrote never does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import results, wcs

_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _one_file_each(rows: DataFrame, key: str):
    """Rows of a key lie in one task. Only the folders of the keys at hand are replaced. Keys are dealt by number:
    Spark would put them together by their bytes, few as they are, and one task would make all files. Tasks
    move their files to the hidden folder of the job themselves, not the driver one after the other; from there
    the job's commit puts the folders in place, as ever."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.repartition(parts, key).write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    return writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2")


def write_wcs(solutions: DataFrame, folder: str) -> None:
    """``folder``/image_id=.../: the header of a solution, to the byte, in whole blocks. The text writer
    ends a row with a character of its own, which stands for the last space of the padding."""
    text = F.decode("content", "US-ASCII")
    rows = wcs.wcs_files(solutions).select("image_id", F.substring(text, F.lit(1), F.length(text) - 1).alias("value"))
    _one_file_each(rows, "image_id").option("lineSep", " ").text(folder)


def write_results(rows: DataFrame, folder: str, extended: bool = False, form: str = "json") -> None:
    """``folder``/image_id=.../: the result of a picture as JSON or as lines of key, tab, value."""
    if form == "json":
        texts = results.as_json(rows, extended).select("image_id", F.col("json").alias("value"))
    elif form == "tsv":
        lines = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
        texts = results.as_tsv(rows, extended).groupBy("image_id").agg(F.array_join(lines, "\n").alias("value"))
    else:
        raise ValueError("form must be json or tsv")
    _one_file_each(texts, "image_id").text(folder)


def write_jobs(jobs: DataFrame, folder: str) -> None:
    """``folder``/job_id=.../: all columns of a job as JSON. Jobs that are there already are replaced, each
    by itself."""
    _one_file_each(jobs, "job_id").json(folder)


def read_jobs(spark: SparkSession, folder: str, schema: str, job_id: str | None = None) -> DataFrame:
    """``schema``: of the columns besides job_id. With ``job_id`` only that folder is opened. Folders are listed
    in as many tasks as a shuffle has, not in one for each."""
    held = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        found = spark.read.schema(f"{schema}, job_id string").option("basePath", folder).json(folder)
    finally:
        spark.conf.set(_LISTING, held)
    return found if job_id is None else found.filter(F.col("job_id") == job_id)
