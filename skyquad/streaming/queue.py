"""From arriving picture files to solved jobs: three streams over the tables of one folder.

``prepare_jobs`` reads the pictures of a micro-batch, detects their stars, takes hints from their headers
and writes queued jobs. ``solve_queue`` takes the jobs of one such batch at a time and solves them, each
as a search of its own that can time out or be cancelled. ``follow`` folds the events of both and the cancel
requests into job states. Every micro-batch writes folders of its own number, so that one that is
repeated after a failure replaces itself: each file becomes one job and each job has one result.

Files that can't be read become jobs in the state Error, with the reason; they aren't solved.

Tables below the root: ``jobs`` (a row per file), ``stars``, ``results`` (a row per job), ``events`` (what
``jobs.job_states`` takes), ``requests`` (cancellations) and ``states``.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index
from ..plans.pictures import Detector, hinted_runs, picture_stars, read_pictures
from ..plans.search import Outcome, search_staged
from ..plans.solve import SOLUTION, SolveOptions, solve_schema
from ..storage import stash
from . import jobs

_FILES = "path string, modificationTime timestamp, length long, content binary"
_JOBS = "job_id string, image_id long, path string, width int, height int, center struct<ra: double, dec: double>, view struct<width_deg: double, height_deg: double>, n_stars long, error string"
_STARS = "job_id string, image_id long, star_id long, x double, y double, brightness long, size double"
_EVENTS = "job_id string, ts timestamp, event string"
_REQUESTS = "job_id string, ts timestamp"
#: Events that end a job, by how its search ended.
_ENDS = {"Success": "succeed", "Failure": "fail", "Timeout": "timeout", "Canceled": "cancel", "Error": "error"}


@dataclass(frozen=True)
class Folders:
    """The tables of one queue."""

    root: str

    def of(self, table: str, number: int | None = None) -> str:
        return f"{self.root}/{table}" + ("" if number is None else f"/batch={number}")

    def events(self, step: str, number: int) -> str:
        return f"{self.root}/events/step={step}/batch={number}"

    def checkpoint(self, stream: str) -> str:
        return f"{self.root}/checkpoints/{stream}"


def job_id(path: Column) -> Column:
    """The same for the same file, whenever its batch is repeated."""
    return F.substring(F.sha2(path, 256), 1, 32)


def _put(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def _stream(spark: SparkSession, schema: str, path: str, at_once: int | None = None) -> DataFrame:
    found = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    return (found if at_once is None else found.option("maxFilesPerTrigger", at_once)).parquet(path)


def create(spark: SparkSession, root: str) -> Folders:
    """The folders of a queue, so that its streams can begin in any order."""
    folders = Folders(root)
    for table, schema in (("jobs", _JOBS), ("events", _EVENTS), ("requests", _REQUESTS)):
        _put(spark.createDataFrame([], schema), f"{folders.of(table)}/start")
    return folders


def prepare_jobs(
    spark: SparkSession, pictures: str, folders: Folders, at_once: int = 5, detector: Detector | None = None, read: Callable[[SparkSession, list[str]], DataFrame] = read_pictures,
) -> StreamingQuery:
    """Files below ``pictures``, ``at_once`` of them in a micro-batch, to jobs. ``read``: paths to pictures."""

    def put(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.select("path").collect()]  # at_once of them
        if not paths:
            return
        found = stash(read(spark, paths), "pictures")
        stars = picture_stars(found, detector)
        counts = stars.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_stars"))
        # What no reader took is a job too, with an error.
        arrived = spark.createDataFrame([(p,) for p in paths], "path string")
        rows = arrived.join(found.drop("data", "bits"), "path", "left").join(counts, "image_id", "left")
        error = F.when(F.col("image_id").isNull(), "not a picture of a known kind").otherwise(F.col("error"))
        prepared = rows.select(job_id(F.col("path")).alias("job_id"), "image_id", "path", F.col("width").cast("int"), F.col("height").cast("int"), "center", "view", F.coalesce("n_stars", F.lit(0).cast("long")).alias("n_stars"), error.alias("error"))
        prepared = stash(prepared, "prepared")
        _put(stars.join(prepared.select("job_id", "image_id"), "image_id").select("job_id", "image_id", "star_id", "x", "y", "brightness", "size"), folders.of("stars", number))
        event = F.explode(F.when(F.col("error").isNull(), F.array(F.lit("submit"))).otherwise(F.array(F.lit("submit"), F.lit("error"))))
        _put(prepared.select("job_id", F.current_timestamp().alias("ts"), event.alias("event")).withColumn("ts", F.when(F.col("event") == "error", F.col("ts") + F.expr("INTERVAL 1 MILLISECOND")).otherwise(F.col("ts"))), folders.events("prepare", number))
        # Last: from here on the batch is seen by the solver. One file, so that it is one unit of its work.
        _put(prepared.coalesce(1), folders.of("jobs", number))

    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", at_once).load(pictures)
    return files.select("path").writeStream.option("checkpointLocation", folders.checkpoint("prepare")).trigger(availableNow=True).foreachBatch(put).start()


def request_cancel(spark: SparkSession, folders: Folders, *job_ids: str) -> None:
    """Ask for jobs to be cancelled, whether they wait or are being solved."""
    rows = spark.createDataFrame([(j,) for j in job_ids], "job_id string").withColumn("ts", F.current_timestamp())
    rows.coalesce(1).write.mode("append").parquet(f"{folders.of('requests')}/{uuid.uuid4().hex}")


class CancelWatch:
    """The control stream as seen by running searches: which of the jobs at work are to be cancelled.
    The driver holds the jobs at work, of which there are few, and not the requests."""

    def __init__(self, spark: SparkSession, folders: Folders):
        self.spark, self.folders, self.lock = spark, folders, threading.Lock()
        self.at_work: dict[str, threading.Event] = {}
        requests = _stream(spark, _REQUESTS, folders.of("requests"))
        self.query = requests.select("job_id").writeStream.foreachBatch(self._seen).trigger(processingTime="500 milliseconds").option("checkpointLocation", folders.checkpoint(f"watch-{uuid.uuid4().hex}")).start()

    def _seen(self, batch: DataFrame, number: int) -> None:
        with self.lock:
            mine = list(self.at_work)
        if mine:
            self._mark([r.job_id for r in batch.filter(F.col("job_id").isin(mine)).distinct().collect()])

    def _mark(self, found: list[str]) -> None:
        with self.lock:
            for j in found:
                if j in self.at_work:
                    self.at_work[j].set()

    def watch(self, job_ids: list[str]) -> None:
        """From now on; requests from before count as well."""
        with self.lock:
            self.at_work.update({j: threading.Event() for j in job_ids})
        earlier = _read(self.spark, _REQUESTS, self.folders.of("requests")).filter(F.col("job_id").isin(job_ids))
        self._mark([r.job_id for r in earlier.select("job_id").distinct().collect()])

    def leave(self, job_ids: list[str]) -> None:
        with self.lock:
            for j in job_ids:
                self.at_work.pop(j, None)

    def cancelled(self, job_id: str) -> bool:
        with self.lock:
            return job_id in self.at_work and self.at_work[job_id].is_set()

    def stop(self) -> None:
        self.query.stop()


def solve_queue(
    spark: SparkSession, folders: Folders, index: Index, options: SolveOptions = SolveOptions(), search_radius: float = 10.0, fallback: DataFrame | None = None,  # noqa: B008
    timeout: float | None = None, parallel: int = 2, at_once: int = 5, solve: Callable[..., Outcome] = search_staged,
) -> StreamingQuery:
    """One prepared batch after the other; its jobs are searched at the same time, ``at_once`` of them.
    ``timeout``: seconds for one job. A job without hints is searched by the runs of ``fallback``."""

    def put(batch: DataFrame, number: int) -> None:
        waiting = stash(batch.filter("error is null"), "jobs")
        rows = waiting.drop("error").collect()  # at_once of prepare_jobs
        if not rows:
            return
        ids = [r.job_id for r in rows]
        watch.watch(ids)
        try:
            begun = [j for j in ids if not watch.cancelled(j)]
            started = spark.createDataFrame([(j,) for j in begun], "job_id string").select("job_id", F.current_timestamp().alias("ts"), F.lit("start").alias("event"))
            _put(started, folders.events("start", number))
            stars = stash(_read(spark, _STARS, folders.of("stars")).filter(F.col("job_id").isin(ids)), "job-stars")

            def one(row) -> tuple[str, Outcome | None, str | None]:
                if watch.cancelled(row.job_id):
                    return "Canceled", None, None
                try:
                    own = waiting.filter(F.col("job_id") == row.job_id)
                    plan = hinted_runs(own, search_radius).drop("image_id") if row.center is not None and row.view is not None else fallback
                    if plan is None:
                        return "Failure", None, None
                    sizes = own.select("image_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))
                    mine = stars.filter(F.col("job_id") == row.job_id).drop("job_id")
                    found = solve(mine, sizes, index, stash(plan, "plan"), options, parallel=parallel, timeout=timeout, cancelled=lambda: watch.cancelled(row.job_id))
                    return found.status, found, None
                except Exception as error:  # a job that breaks is a job in error, and not the end of the queue
                    return "Error", None, str(error)[:500]

            with ThreadPoolExecutor(at_once) as pool:
                ended = list(pool.map(one, rows))
            results = spark.createDataFrame([(r.job_id, r.image_id, status, error) for r, (status, _, error) in zip(rows, ended, strict=True)], "job_id string, image_id long, status string, error string")
            solved = spark.createDataFrame([], solve_schema())
            for _, outcome, _ in ended:
                if outcome is not None and outcome.n_solved:
                    solved = solved.unionByName(outcome.solved)
            _put(results.join(solved.select(*SOLUTION), "image_id", "left"), folders.of("results", number))
            ends = F.create_map(*[F.lit(x) for pair in _ENDS.items() for x in pair])
            _put(results.select("job_id", F.current_timestamp().alias("ts"), F.element_at(ends, F.col("status")).alias("event")), folders.events("end", number))
        finally:
            watch.leave(ids)

    watch = CancelWatch(spark, folders)
    arrivals = _stream(spark, _JOBS, folders.of("jobs"), 1)  # a prepared batch is one file
    query = arrivals.writeStream.option("checkpointLocation", folders.checkpoint("solve")).trigger(availableNow=True).foreachBatch(put).start()
    threading.Thread(target=lambda: (_ended(query), watch.stop()), daemon=True).start()
    return query


def _ended(query: StreamingQuery) -> None:
    try:
        query.awaitTermination()
    except Exception:  # noqa: S110  whoever started the query hears of it from the query
        pass


def follow(spark: SparkSession, folders: Folders, lifetime_ms: int | None = None, lateness: str = jobs.LATENESS) -> StreamingQuery:
    """States of all jobs, from the events of both streams and the control stream."""
    events = jobs.with_cancellations(_stream(spark, _EVENTS, folders.of("events")), _stream(spark, _REQUESTS, folders.of("requests")))
    return jobs.write_states(jobs.job_states(events, lifetime_ms, lateness), folders.of("states"), folders.checkpoint("states"))


def prepared(spark: SparkSession, folders: Folders) -> DataFrame:
    """A row per file that has arrived."""
    return _read(spark, _JOBS, folders.of("jobs"))


def results(spark: SparkSession, folders: Folders) -> DataFrame:
    """A row per job that was tried, and the rows of files that couldn't be read."""
    broken = _read(spark, _JOBS, folders.of("jobs")).filter("error is not null").select("image_id", "job_id", F.lit("Error").alias("status"), "error")
    tried = spark.read.option("basePath", folders.of("results")).parquet(folders.of("results")).drop("batch")
    return tried.unionByName(broken, allowMissingColumns=True)
