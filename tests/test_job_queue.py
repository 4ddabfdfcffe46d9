"""Job states in event time, cancellations, and the way of picture files through the queue."""

from __future__ import annotations

import itertools
import random
import threading
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_engine import png
from test_pictures import built, drawn  # noqa: F401  built is a fixture

from skyquad.fixtures import CENTER
from skyquad.plans import runs
from skyquad.plans.search import Outcome, search_staged
from skyquad.plans.solve import SolveOptions
from skyquad.streaming import jobs, queue

SCHEMA = "job_id string, ts timestamp, event string"
START = datetime(2024, 1, 1)


def streamed(spark, folder, batches, lifetime_ms=None, lateness="10 minutes"):
    """The states after each of the micro-batches. Rows: job, minutes, event."""
    for n, rows in enumerate(batches):
        table = spark.createDataFrame([(j, START + timedelta(minutes=m), e) for j, m, e in rows], SCHEMA)
        table.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        jobs.write_states(jobs.job_states(stream, lifetime_ms, lateness), f"{folder}/out", f"{folder}/check").awaitTermination()
        yield n, {r.job_id: (r.status, None if r.updated is None else (r.updated - START) / timedelta(minutes=1), r.n_events) for r in jobs.latest_states(spark, f"{folder}/out").collect()}


def folded(rows):
    out = {}
    for job, group in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1], r[2])), key=lambda r: r[0]):
        group = list(group)
        status, at = jobs.fold(None, None, [(m, e) for _, m, e in group])
        out[job] = (status, at, len(group))
    return out


def test_events_that_come_late_find_their_place(spark, tmp_path):
    """The second micro-batch has events from before those of the first."""
    batches = [
        [("a", 0, "submit"), ("a", 5, "succeed"), ("b", 4, "start"), ("c", 1, "submit")],
        [("a", 3, "start"), ("b", 2, "submit"), ("c", 2, "cancel"), ("d", 6, "submit")],
        [("c", 1.5, "start"), ("b", 5, "succeed")],
    ]
    want = [{"a": ("Queued", 0, 2), "b": (None, None, 1), "c": ("Queued", 1, 1)}]
    for n, states in streamed(spark, tmp_path, batches):
        assert states == folded([r for b in batches[: n + 1] for r in b])
        assert n or states == want[0]
    assert states["a"] == ("Success", 5, 3) and states["b"] == ("Success", 5, 3) and states["c"] == ("Canceled", 2, 3)


def test_states_by_brute_force(spark, tmp_path):
    rng = random.Random(2)
    events = ["submit", "start", "succeed", "fail", "error", "timeout", "cancel"]
    rows = [(f"j{rng.randrange(12)}", m + rng.random(), rng.choice(events)) for m in range(90)]
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 9))  # out of order, by less than the lateness
    batches = [rows[i : i + 30] for i in range(0, 90, 30)]
    for n, states in streamed(spark, tmp_path, batches):
        got = {k: (s, None if t is None else round(t, 4), c) for k, (s, t, c) in states.items()}
        assert got == {k: (s, None if t is None else round(t, 4), c) for k, (s, t, c) in folded([r for b in batches[: n + 1] for r in b]).items()}


def test_too_late_events_are_dropped_and_old_jobs_purged(spark, tmp_path):
    hour = 3_600_000
    batches = [[("a", 0, "submit"), ("b", 0, "submit")], [("b", 100, "start"), ("c", 100, "submit")], [("b", 1, "cancel"), ("c", 101, "start")], [("c", 300, "succeed")], [("c", 301, "cancel")]]
    seen = dict(streamed(spark, tmp_path, batches, lifetime_ms=hour))
    assert set(seen[0]) == {"a", "b"}
    assert seen[2]["b"] == ("Solving", 100, 2)  # the cancellation is 99 minutes late
    assert "a" not in seen[2] and "b" in seen[2]
    assert set(seen[4]) == {"c"} and seen[4]["c"] == ("Success", 300, 4)
    rows = spark.read.parquet(f"{tmp_path}/out").filter("purged").collect()
    assert sorted((r.job_id, r.status) for r in rows) == [("a", "Queued"), ("b", "Solving")]


@pytest.fixture
def inbox(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a_sky.fits").write_bytes(drawn(spark))
    (folder / "b_plain.fit").write_bytes(drawn(spark, hint=False))
    (folder / "c_dark.png").write_bytes(png(np.zeros((20, 30, 1), dtype=np.int64), 0, 8))
    (folder / "d_broken.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    (folder / "e_notes.txt").write_bytes(b"no picture")
    return folder


def named(rows):
    return {r.path.rsplit("/", 1)[1]: r for r in rows}


def test_files_to_final_states(spark, tmp_path, inbox, built):  # noqa: F811
    folders = queue.create(spark, f"file://{tmp_path}/queue")
    queue.prepare_jobs(spark, str(inbox), folders, at_once=2).awaitTermination()
    prepared = named(spark.read.parquet(f"{folders.of('jobs')}/batch=*").collect())
    assert len(prepared) == 5 and prepared["a_sky.fits"].n_stars > 20 and prepared["a_sky.fits"].center is not None and prepared["b_plain.fit"].center is None
    assert prepared["d_broken.png"].error.startswith("PNG") and prepared["e_notes.txt"].error == "not a picture of a known kind"
    # Cancelled while it waits: it is never searched.
    queue.request_cancel(spark, folders, prepared["b_plain.fit"].job_id)
    fallback = runs.point_runs(spark, 18.05, 0.45, 5.73)
    queue.solve_queue(spark, folders, built, SolveOptions(sampling=1), 2.0, fallback).awaitTermination()
    ids = {r.job_id: n for n, r in prepared.items()}
    done = {ids[r.job_id]: r for r in queue.results(spark, folders).collect()}
    assert {n: r.status for n, r in done.items()} == {"a_sky.fits": "Success", "b_plain.fit": "Canceled", "c_dark.png": "Failure", "d_broken.png": "Error", "e_notes.txt": "Error"}
    assert abs(done["a_sky.fits"].ra - CENTER[0]) < 0.02 and done["b_plain.fit"].ra is None
    queue.follow(spark, folders).awaitTermination()
    states = {ids[r.job_id]: r.status for r in jobs.latest_states(spark, folders.of("states")).collect()}
    assert states == {n: r.status for n, r in done.items()}
    # Nothing is done twice: neither for files that were there nor for jobs that are done.
    queue.prepare_jobs(spark, str(inbox), folders, at_once=2).awaitTermination()
    queue.solve_queue(spark, folders, built, SolveOptions(sampling=1), 2.0, fallback).awaitTermination()
    assert spark.read.parquet(f"{folders.of('jobs')}/batch=*").count() == 5 and queue.results(spark, folders).count() == 5


def test_a_repeated_batch_replaces_itself(spark, tmp_path, inbox, built):  # noqa: F811
    """The solver breaks after it has written; its batch is repeated from the start."""
    folders = queue.create(spark, f"file://{tmp_path}/queue")
    queue.prepare_jobs(spark, str(inbox), folders, at_once=9).awaitTermination()
    calls = []

    def solve(*args, **kwargs):
        calls.append(1)
        return Outcome("Failure", None, 0, 1, 0)

    put, broken = queue._put, []

    def breaks(rows, path):
        put(rows, path)
        if "/step=end/" in path and not broken:
            broken.append(path)
            raise OSError("planted")

    queue._put = breaks
    try:
        plan = runs.point_runs(spark, 18.0, 0.5, 5.7)
        with pytest.raises(Exception, match="planted"):
            queue.solve_queue(spark, folders, built, fallback=plan, solve=solve).awaitTermination()
        queue.solve_queue(spark, folders, built, fallback=plan, solve=solve).awaitTermination()
    finally:
        queue._put = put
    assert len(calls) == 6  # three pictures that can be read, twice
    found = queue.results(spark, folders).groupBy("job_id").count().collect()
    assert len(found) == 5 and all(r["count"] == 1 for r in found)


def test_a_job_is_cancelled_while_it_is_solved_and_another_times_out(spark, tmp_path, built):  # noqa: F811
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("one", "two"):
        (folder / f"{name}.fits").write_bytes(drawn(spark))
    folders = queue.create(spark, f"file://{tmp_path}/queue")
    queue.prepare_jobs(spark, str(folder), folders).awaitTermination()
    ids = {n: r.job_id for n, r in named(spark.read.parquet(f"{folders.of('jobs')}/batch=*").collect()).items()}
    at_work = threading.Event()

    def endless(stars, sizes, index, plan, options, parallel, timeout, cancelled):
        """As a search whose first stage takes a minute."""
        slow = stars.mapInPandas(lambda batches: (time.sleep(60) or b for b in batches), stars.schema)
        at_work.set()
        return search_staged(slow, sizes, index, plan, options, parallel, timeout, cancelled)

    began = time.monotonic()
    query = queue.solve_queue(spark, folders, built, SolveOptions(sampling=1), 2.0, timeout=25, solve=endless)
    assert at_work.wait(60)
    queue.request_cancel(spark, folders, ids["one.fits"])
    query.awaitTermination()
    assert time.monotonic() - began < 55
    found = {r.job_id: r.status for r in queue.results(spark, folders).collect()}
    assert found == {ids["one.fits"]: "Canceled", ids["two.fits"]: "Timeout"}
    queue.follow(spark, folders).awaitTermination()
    assert {r.job_id: r.status for r in jobs.latest_states(spark, folders.of("states")).collect()} == found
    assert spark.sparkContext.statusTracker().getActiveJobsIds() == []
    assert spark.createDataFrame([(ids["one.fits"],)], "job_id string").select(jobs.numeric_id("job_id")).first()[0] == spark.range(1).select(F.xxhash64(F.lit(ids["one.fits"]))).first()[0]
