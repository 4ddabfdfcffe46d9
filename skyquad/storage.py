"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}  # folders of local sessions without a setting, by application


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where none is set and all runs on this machine, as in
    tests, a temporary one is; on a cluster that is an error, as executors see no folder of the driver's."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        found = _LOCAL[app]
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own for each call, grouped by application: ``remove_tables`` deletes them together."""
    return f"{shared_folder(spark)}/skyquad-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of a query once it has ended, not when the driver's garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writers: dict[str, list] = {}  # of each session: how many threads write just now, and the setting before them


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """The setting holds while any thread of the session writes, and is put back after the last one."""
    key = str(spark._jsparkSession.sessionUUID())
    with _lock:
        held = _writers.setdefault(key, [0, spark.conf.get(_CLEANUP, None)])
        held[0] += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                del _writers[key]
                if held[1] is None:
                    spark.conf.unset(_CLEANUP)
                else:
                    spark.conf.set(_CLEANUP, held[1])


class Stashed(NamedTuple):
    table: DataFrame
    path: str
    facts: dict


def stash_observed(df: DataFrame, name: str, **metrics: Column) -> Stashed:
    """As ``stash``, with aggregates of the rows that are observed while they are written: no job of
    their own. ``n``, the number of rows, is always among them."""
    spark, path, seen = df.sparkSession, new_folder(df.sparkSession, name), Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in metrics.items()])
    with _cleaned(spark):
        observed.select("*").write.option("compression", "zstd").parquet(path)
    return Stashed(spark.read.schema(df.schema).parquet(path), path, seen.get)


def stash(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: later steps don't repeat its work, a lost executor costs
    no more than its own tasks, and plans stay small. The table replaces the shuffles behind it,
    whose files are removed, so that jobs of many steps don't fill the executors' disks."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    with _cleaned(spark):
        # A query of its own, made while the setting holds.
        df.select("*").write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession) -> None:
    """Delete every table this application has written between steps. Results are lazy and read
    them, so call it once the results are written or no longer needed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/skyquad-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
