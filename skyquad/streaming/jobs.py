"""Solve jobs: a stream of job events to job states, queue, purge, lookup.

Events are rows of job_id (string), ts, event (submit, start, succeed, fail, error, timeout,
cancel). State is keyed by job, so jobs spread over all tasks and each task holds its own share. The
streams that make these events, from picture files to solutions, are in ``queue``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.base import Value, col

#: What an event makes of a job; an event that a state doesn't list changes nothing.
TRANSITIONS = {
    None: {"submit": "Queued"},
    "Queued": {"start": "Solving", "cancel": "Canceled", "error": "Error"},
    "Solving": {"succeed": "Success", "fail": "Failure", "error": "Error", "timeout": "Timeout", "cancel": "Canceled"},
}
STATES = ["Queued", "Solving", "Success", "Failure", "Error", "Timeout", "Canceled"]
_OUT = "job_id string, status string, updated_us long, n_events long, purged boolean"
_STATE = "status string, updated long, n_events long, seen long, waiting_us array<long>, waiting array<string>"
LATENESS = "10 minutes"


def fold(status: str | None, updated: int | None, events: list[tuple[int, str]]) -> tuple[str | None, int | None]:
    """A job's state and the time of its last change after events (time, event), which are in order."""
    for at, event in events:
        moved = TRANSITIONS.get(status, {}).get(event)
        if moved is not None:
            status, updated = moved, at
    return status, updated


def _advance(lifetime_ms: int | None) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, updated, n, seen, times, names = state.get if state.exists else (None, None, 0, None, [], [])
        events = list(zip(times, names, strict=True))
        if not state.hasTimedOut:
            for batch in batches:
                events += zip(batch["us"].tolist(), batch["event"].tolist(), strict=True)
        n += len(events) - len(times)
        events.sort()
        now = state.getCurrentWatermarkMs() * 1000
        settled, left = [e for e in events if e[0] <= now], [e for e in events if e[0] > now]
        status, updated = fold(status, updated, settled)
        seen = max([e[0] for e in events] + ([] if seen is None else [seen]), default=None)
        shown = fold(status, updated, left)
        ends = None if lifetime_ms is None or seen is None else (seen if updated is None else updated) + lifetime_ms * 1000
        purged = not left and ends is not None and ends < now
        if purged:
            state.remove()
        else:
            state.update((status, updated, n, seen, [e[0] for e in left], [e[1] for e in left]))
            wake = [t for t in (left[0][0] if left else None, ends) if t is not None]
            if wake:
                state.setTimeoutTimestamp(max(min(wake), now) // 1000 + 1)
        out = pd.DataFrame([(key[0], n, purged)], columns=["job_id", "n_events", "purged"])
        out.insert(1, "status", pd.Series([shown[0]], dtype=object))
        out.insert(2, "updated_us", pd.Series([shown[1]], dtype="Int64"))
        yield out

    return run


def job_states(events: DataFrame, lifetime_ms: int | None = None, lateness: str = LATENESS) -> DataFrame:
    """A streaming DataFrame of changes (update mode): job_id, status, updated, n_events, purged.

    Time is that of the events. What the watermark has passed is folded for good, in the order of its
    times; what it hasn't waits in the job's state and is folded on top in each answer, so events that come
    in a later micro-batch than newer ones find their place, up to ``lateness``. Later ones than that
    are dropped. Jobs whose last change is ``lifetime_ms`` behind the watermark are purged: they leave the
    state and are reported once more. A job's state holds its events of ``lateness``, no more.
    """
    timed = events.select("job_id", F.col("ts").cast("timestamp").alias("ts"), "event").withWatermark("ts", lateness).select("job_id", "ts", "event", F.unix_micros("ts").alias("us"))
    found = timed.groupBy("job_id").applyInPandasWithState(_advance(lifetime_ms), _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return found.select("job_id", "status", F.timestamp_micros("updated_us").alias("updated"), "n_events", "purged")


def with_cancellations(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Job events and a control stream of cancel requests (job_id, ts) as one stream of events."""
    named = [d.select("job_id", F.col("ts").cast("timestamp").alias("ts"), e) for d, e in ((events, F.col("event")), (requests, F.lit("cancel").alias("event")))]
    return named[0].unionByName(named[1])


def write_states(states: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch as a folder of its own, so that a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def latest_states(spark: SparkSession, folder: str) -> DataFrame:
    """The current row of every job that isn't purged."""
    rows = spark.read.option("basePath", folder).parquet(folder)
    best = F.max_by(F.struct("status", "updated", "n_events", "purged"), "batch")
    return rows.groupBy("job_id").agg(best.alias("b")).select("job_id", "b.*").filter("not purged").drop("purged")


def latest_status(events: DataFrame) -> DataFrame:
    """Batch form of the lookup: each job's last event."""
    return events.groupBy("job_id").agg(F.max_by("event", F.struct("ts", "event")).alias("event"), F.max("ts").alias("updated"), F.count(F.lit(1)).alias("n_events"))


def purge(jobs: DataFrame, now: Column, lifetime: str = "INTERVAL 7 DAYS") -> DataFrame:
    """Jobs whose last change is within their lifetime."""
    return jobs.filter(F.col("updated") + F.expr(lifetime) >= now)


def queue_order(submitted: DataFrame, workers: int) -> DataFrame:
    """First in, first out: position in the queue, and the worker of each round of ``workers`` jobs.
    Ranks within time buckets are moved up by the counts of earlier buckets, so no task sees all jobs."""
    dealt = submitted.withColumn("_bucket", F.date_trunc("hour", "ts"))
    counts = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # A row per hour of queueing: small enough for one task.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("ts", "job_id"))
    placed = dealt.withColumn("_i", inside).join(starts.drop("_n"), "_bucket")
    position = (F.col("_start") + F.col("_i") - 1).cast("long")
    return placed.withColumn("position", position).withColumn("worker", (F.col("position") % workers).cast("int")).drop("_bucket", "_i", "_start")


def first_in_queue(submitted: DataFrame, n: int) -> DataFrame:
    """The ``n`` jobs that have waited longest: a top-n, for which no task sorts all jobs."""
    return submitted.orderBy("ts", "job_id").limit(n)


def solve_arrivals(spark: SparkSession, folder: str, solve: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, at_once: int = 5) -> StreamingQuery:
    """Picture files as they arrive in ``folder``, ``at_once`` in a micro-batch: read, handed to ``solve``
    (pictures as ``plans.pictures.read_pictures`` gives them to a row for each) and written, a folder
    for each batch, so that a repeated batch replaces itself."""
    from ..plans.pictures import read_pictures

    def put(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.select("path").collect()]  # at_once of them
        if paths:
            solve(read_pictures(spark, paths)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", at_once)
    return files.load(folder).select("path").writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def short_id(guid: Value) -> Column:
    """Base64 of a GUID's 16 bytes (given as hex with dashes), letters and digits only. The first
    three groups are byte-swapped, as GUIDs are stored."""
    h = F.regexp_replace(col(guid), "-", "")
    byte = lambda i: F.substring(h, 2 * i + 1, 2)
    order = [3, 2, 1, 0, 5, 4, 7, 6, *range(8, 16)]
    return F.regexp_replace(F.base64(F.unhex(F.concat(*[byte(i) for i in order]))), "[/+=\r\n]", "")


def numeric_id(job_id: Value) -> Column:
    return F.xxhash64(col(job_id))


def legacy_status(status: Value) -> Column:
    status = col(status)
    return F.when(status == "Solving", "solving").when(status == "Queued", "none").when(status == "Success", "success").when(status.isNull(), "none").otherwise("failure")


#: What clients see of a job, by the column it comes from.
_REST = {
    "id": "job_id", "status": "status", "imageWidth": "width", "imageHeight": "height", "starsDetected": "n_stars", "starsUsed": "stars_used",
    "originalFilename": "file_name", "updated": "updated", "solveStarted": "started",
}
_REST_SOLUTION = {"ra": "ra", "dec": "dec", "fieldRadius": "radius", "orientation": "orientation", "pixScale": "pix_scale", "parity": "parity"}


def rest_view(jobs: DataFrame) -> DataFrame:
    """Jobs as clients see them; ``solution`` is null where a job has none."""
    solution = F.when(F.col("ra").isNotNull(), F.struct(*[F.col(c).alias(k) for k, c in _REST_SOLUTION.items()]))
    return jobs.select(*[F.col(c).alias(k) for k, c in _REST.items() if c in jobs.columns], solution.alias("solution"))


def calibration(jobs: DataFrame) -> DataFrame:
    """Results of successful jobs as older clients expect them."""
    return jobs.filter(F.col("status") == "Success").select(
        "job_id", "orientation", "radius", "ra", "dec", F.when(F.lower("parity") == "normal", -1).otherwise(1).alias("parity"),
        (F.col("pix_scale") * F.col("width")).alias("width_arcsec"), (F.col("pix_scale") * F.col("height")).alias("height_arcsec"), F.col("pix_scale").alias("pixscale"),
    )


def legacy_field_radii(jobs: DataFrame) -> DataFrame:
    """Adds valid, max_field_radius and min_field_radius from scale_type (ul: lower and upper, ev:
    estimate), scale_units, scale_lower, scale_upper, scale_est, center_ra, center_dec,
    search_radius, width and height. Field *widths* are used as radii, as in the original;
    arc seconds per pixel become half the diagonal. Without a center only the search radius counts."""
    low, high, est = F.col("scale_lower"), F.col("scale_upper"), F.col("scale_est")
    centered = F.col("center_ra").isNotNull() & F.col("center_dec").isNotNull()
    in_sky = F.col("center_dec").between(-90, 90) & F.col("center_ra").between(0, 360)
    pair_ok = low.isNotNull() & high.isNotNull() & (F.coalesce(low, F.lit(0e0)) <= F.coalesce(high, F.lit(0e0))) & (F.coalesce(low, F.lit(0e0)) > 0)
    kind = F.col("scale_type")
    scale_ok = F.when(kind.isNull(), True).when(kind == "ul", pair_ok).when(kind == "ev", est.isNotNull()).otherwise(False)
    radius_ok = F.col("search_radius").isNull() | (F.coalesce(F.col("search_radius"), F.lit(1e0)) > 0)
    valid = radius_ok & (~centered | (F.coalesce(in_sky, F.lit(False)) & scale_ok))
    half = F.sqrt((F.col("width") * F.col("width") + F.col("height") * F.col("height")).cast("double")) * 0.5 / 3600e0
    factor = F.when(F.col("scale_units") == "degwidth", F.lit(1e0)).when(F.col("scale_units") == "arcminwidth", F.lit(1 / 60)).when(F.col("scale_units") == "arcsecperpix", half)
    used = valid & centered
    return jobs.withColumns({
        "valid": valid,
        "max_field_radius": F.when(used & (kind == "ul"), high * factor).when(used & (kind == "ev"), est * factor),
        "min_field_radius": F.when(used & (kind == "ul"), low * factor).when(used & (kind == "ev"), est * factor),
    })
