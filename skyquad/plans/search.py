"""Searches in stages: several at once, with early exit, that can be watched, cancelled and timed.

A plan is cut into stages: subsets of the subcells' quads, within them radius groups from the largest
on, within these batches of runs. A stage first counts potential matches on its subset; runs with
five or more are solved on all quads, and where a picture is left open, runs with any are, most hits
first. A run that had any is left out of later subsets.

Up to ``parallel`` stages run at once, each from a thread of its own whose jobs go to a fair scheduler
pool and carry the search's tag and the stage's. A later stage may end first, but results are taken
in the order of the plan, so the winner is the same for any ``parallel``: the first success. Once all
pictures are solved, or a stage has solved all that are open, the jobs of later stages are cancelled.

A timeout or a caller's wish ends the search inside a stage: all jobs with its tag are cancelled, in a
second or so, and no stage starts another one.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import deque
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.angles import position_label
from ..operators import match
from ..operators.index import Index
from ..operators.quads import brightest
from ..sinks.results import time_text
from ..storage import new_folder, stash, stash_observed
from .runs import by_radius
from .solve import Search, SolveOptions, count_potential, find_potential, first_success, open_search, prepare_runs, runs_of_pictures, solve_runs, solve_schema

#: The steps that are told to ``progress``. Those before quads are told by whoever reads pictures.
STEPS = (
    "image_read_started", "image_read_finished", "star_detection_started", "star_detection_finished",
    "quad_formation_started", "quad_formation_finished", "solve_process_started", "solve_process_finished",
)
#: How an ended search stands.
SUCCESS, FAILURE, TIMEOUT, CANCELED = "Success", "Failure", "Timeout", "Canceled"
_BATCHES = ((2_999, 1000), (24_999, 2500))  # runs in a group up to which a batch size holds; 4000 beyond
_SERIAL_BATCH = 1000
_POLL = 0.1
Progress = Callable[[str, dict], None]


class Stopped(Exception):
    """Raised between the steps of a stage that isn't wanted any more."""


@dataclass(frozen=True)
class Stage:
    number: int
    subset: int
    radius_group: int
    low: int
    high: int  # run_ids from low to below high
    n: int  # runs that there are


@dataclass
class Outcome:
    """``status``: Success if every picture was solved, Failure if some weren't, or Timeout or Canceled.
    ``solved``: a row per solved picture, also where the search was stopped. ``stages``: that were done."""

    status: str
    solved: DataFrame
    stages: int
    pictures: int
    n_solved: int
    seconds: float = 0.0
    areas: int = 0  # runs of the stages that were done


class Control:
    """The jobs of one search: submits its steps to threads, and stops them."""

    def __init__(self, spark: SparkSession, parallel: int, timeout: float | None, cancelled: Callable[[], bool] | None):
        self.sc, self.tag = spark.sparkContext, f"skyquad-search-{uuid.uuid4().hex}"
        self.pool = ThreadPoolExecutor(parallel, thread_name_prefix="search")
        self.deadline = None if timeout is None else time.monotonic() + timeout
        self.cancelled = cancelled or (lambda: False)
        self.reason: str | None = None
        self.unwanted: set[int] = set()
        self.lock = threading.Lock()

    def submit(self, number: int, f: Callable, *args) -> Future:
        def run():
            sc, tags = self.sc, (self.tag, f"{self.tag}-{number}")
            for tag in tags:
                sc.addJobTag(tag)
            sc.setLocalProperty("spark.scheduler.pool", f"search-{number % 64}")
            try:
                self.check(number)
                return f(lambda: self.check(number), *args)
            finally:
                sc.setLocalProperty("spark.scheduler.pool", None)
                for tag in tags:
                    sc.removeJobTag(tag)

        return self.pool.submit(run)

    def check(self, number: int) -> None:
        if self.reason or number in self.unwanted:
            raise Stopped

    def drop(self, numbers: list[int]) -> None:
        """End these stages, which can't change the result any more."""
        self.unwanted.update(numbers)
        for n in numbers:
            self.sc.cancelJobsWithTag(f"{self.tag}-{n}")

    def wait(self, futures: list[Future]) -> None:
        """Until one of them has ended, or the search is to stop."""
        while not wait(futures, _POLL, FIRST_COMPLETED).done:
            self._look()
            if self.reason:
                raise Stopped
        self._look()
        if self.reason:
            raise Stopped

    def _look(self) -> None:
        if self.cancelled():
            self.reason = CANCELED
        elif self.deadline is not None and time.monotonic() > self.deadline:
            self.reason = TIMEOUT

    def close(self, futures: list[Future]) -> None:
        """No job of this search is left when it returns: a step may submit one just as others are cancelled."""
        self.reason = self.reason or "ended"
        while not all(f.done() for f in futures):
            self.sc.cancelJobsWithTag(self.tag)
            wait(futures, _POLL)
        self.pool.shutdown()


def batch_size(group: int) -> int:
    """Runs in a stage, by the number of runs of its radius."""
    return next((size for most, size in _BATCHES if group <= most), 4000)


def serial_batch_size(group: int) -> int:
    return _SERIAL_BATCH


def plan_stages(runs: DataFrame, subsets: int, batches: Callable[[int], int] = batch_size) -> list[Stage]:
    """``runs``: run_id and radius_group, contiguous in each group. A row per radius is collected: some dozen."""
    groups = runs.groupBy("radius_group").agg(F.min("run_id").alias("first"), F.max("run_id").alias("last"), F.count(F.lit(1)).alias("n")).orderBy("radius_group").collect()
    places = [(s, g, at, batches(g["n"])) for s in range(subsets) for g in groups for at in range(g["first"], g["last"] + 1, batches(g["n"]))]
    return [Stage(k, s, g["radius_group"], at, at + size, min(size, g["last"] + 1 - at)) for k, (s, g, at, size) in enumerate(places)]


@dataclass
class Done:
    """What a stage found: tables with their numbers of rows, and the runs that had any potential match.
    ``given``: the number of pictures that were open when it began."""

    stage: Stage
    given: int
    found: list[tuple[DataFrame, int]]
    tried: str | None
    n_asked: int
    n_runs: int = 0
    n_matching: int = 0

    @property
    def n_found(self) -> int:
        return sum(n for _, n in self.found)


def run_stage(check: Callable[[], None], search: Search, given: int, runs: DataFrame, stage: Stage, tried: DataFrame | None) -> Done:
    """``search.pictures``: those that are open."""
    batch = runs.filter((F.col("radius_group") == stage.radius_group) & (F.col("run_id") >= stage.low) & (F.col("run_id") < stage.high)).drop("radius_group")
    asked = prepare_runs(search, runs_of_pictures(search, batch))
    if tried is not None:
        asked = asked.join(tried, ["image_id", "run_id"], "left_anti")
    many = F.col("n_potential") >= match.LEAST_MATCHES
    hits = stash_observed(count_potential(find_potential(search, asked, search.options.subsets, stage.subset)), "hits", many=F.count_if(many))
    done, pictures = Done(stage, given, [], hits.path, stage.n, hits.facts["n"], hits.facts["many"]), search.pictures
    for chosen, n in ((many, hits.facts["many"]), (~many, hits.facts["n"] - hits.facts["many"] if search.options.subsets > 1 else 0)):
        check()
        if not n:
            continue
        found = stash_observed(first_success(solve_runs(replace(search, pictures=pictures), batch, hits.table.filter(chosen).select("image_id", "run_id"))), "found")
        if found.facts["n"]:
            done.found.append((found.table, found.facts["n"]))
            pictures = pictures.join(found.table, "image_id", "left_anti")
    return done


def search_staged(
    stars: DataFrame, pictures: DataFrame, index: Index, runs: DataFrame, options: SolveOptions = SolveOptions(), parallel: int = 4,  # noqa: B008
    timeout: float | None = None, cancelled: Callable[[], bool] | None = None, progress: Progress | None = None, batches: Callable[[int], int] = batch_size,
) -> Outcome:
    """``timeout`` in seconds, for the whole search; ``cancelled`` is asked some ten times a second.
    ``progress`` hears of ``STEPS`` from quads on, and of every stage as ``batch_done``, with counts that
    were observed while tables were written. It is called from the caller's thread."""
    spark = stars.sparkSession
    tell = progress or (lambda step, facts: None)
    control, began, areas = Control(spark, max(1, parallel), timeout, cancelled), time.monotonic(), 0
    futures: list[Future] = []
    parts, n_solved, waiting, n_pictures, merged = new_folder(spark, "solved"), 0, 0, 0, 0
    written: list[str] = []

    def opened(check: Callable[[], None]):
        planned = stash(by_radius(runs), "plan")
        check()
        found = open_search(stars, pictures, index, options, runs)
        check()
        return found, planned, plan_stages(planned, options.subsets, batches), pictures.count()

    try:
        tell("quad_formation_started", {})
        futures.append(control.submit(-1, opened))
        control.wait(futures)
        search, runs, stages, waiting = futures[0].result()
        n_pictures = waiting
        tell("quad_formation_finished", {"pictures": waiting, "quads": search.n_quads, "pairs": search.n_pairs})
        tell("solve_process_started", {"stages": len(stages)})
        at_work: deque[tuple[Stage, Future]] = deque()
        tried: list[str] = []
        ahead = iter(stages)
        enough = False  # some stage at work has solved all that it was given, and so all that is open: no later one counts
        while waiting:
            while len(at_work) < parallel and not enough and (stage := next(ahead, None)):
                known = spark.read.schema("image_id long, run_id long, n_potential long").parquet(*tried) if tried else None
                futures.append(control.submit(stage.number, run_stage, search, waiting, runs, stage, known))
                at_work.append((stage, futures[-1]))
            if not at_work:
                break
            control.wait([f for _, f in at_work if not f.done()] or [at_work[0][1]])
            for place, (_, future) in enumerate(at_work):
                if not enough and future.done() and not future.exception() and future.result().n_found == future.result().given:
                    enough = True
                    control.drop([s.number for s, _ in list(at_work)[place + 1 :]])
                    at_work = deque(list(at_work)[: place + 1])
            while at_work and at_work[0][1].done():
                done = at_work.popleft()[1].result()
                merged, areas = merged + 1, areas + done.n_asked
                tried.append(done.tried)
                new = 0
                for table, _ in done.found:
                    part = stash_observed(table.join(search.pictures.select("image_id"), "image_id", "left_semi").select(*table.columns), "solved")
                    if part.facts["n"]:
                        written.append(part.path)
                        new += part.facts["n"]
                        search = replace(search, pictures=stash(search.pictures.join(part.table, "image_id", "left_anti"), "pictures"))
                waiting, n_solved = waiting - new, n_solved + new
                tell("batch_done", {"subset": done.stage.subset, "radius_group": done.stage.radius_group, "runs": done.stage.low, "with_matches": done.n_runs, "solved": new})
                if not waiting:
                    break
        control.reason = control.reason or (FAILURE if waiting else SUCCESS)
    except Stopped:
        pass
    finally:
        control.close(futures)
    solved = spark.read.schema(solve_schema()).parquet(*written) if written else spark.createDataFrame([], solve_schema())
    status = control.reason
    tell("solve_process_finished", {"status": status, "pictures": n_pictures, "solved": n_solved, "stages": merged})
    return Outcome(status, solved, merged, n_pictures, n_solved, time.monotonic() - began, areas)


def result_rows(outcome: Outcome, stars: DataFrame, pictures: DataFrame, runs: DataFrame, options: SolveOptions = SolveOptions()) -> DataFrame:  # noqa: B008
    """A row for each picture, as ``sinks.results`` writes it: the solution, success, the stars that were
    detected and used, the time and the areas of the search, and the run that found it."""
    counts = stars.groupBy("image_id").agg(F.count(F.lit(1)).alias("stars_detected"))
    # The same choice as the search made: by brightness, up to a limit that may depend on their number.
    used = brightest(stars, options.max_stars).groupBy("image_id").agg(F.count(F.lit(1)).alias("stars_used"))
    at = runs.select("run_id", *(["image_id"] if "image_id" in runs.columns else []), position_label("ra", "dec", 3).alias("run_center"), F.col("radius").alias("run_radius"))
    solved = outcome.solved.join(at, [c for c in ("image_id", "run_id") if c in at.columns], "left").drop("width", "height")
    rows = pictures.select("image_id", "width", "height").join(counts, "image_id", "left").join(used, "image_id", "left").join(solved, "image_id", "left")
    zero = F.lit(0).cast("long")
    return rows.withColumns({
        "success": F.col("ra").isNotNull(), "stars_detected": F.coalesce("stars_detected", zero), "stars_used": F.coalesce("stars_used", zero),
        "time_spent": time_text(F.lit(outcome.seconds)), "areas_searched": F.lit(outcome.areas).cast("long"),
    })


def solve_staged(
    stars: DataFrame, pictures: DataFrame, index: Index, runs: DataFrame, options: SolveOptions = SolveOptions(),  # noqa: B008
    progress: Progress | None = None, cancelled: Callable[[], bool] | None = None,
) -> DataFrame | None:
    """One stage after the other, in batches of 1000. A row per solved picture, or None if cancelled."""
    outcome = search_staged(stars, pictures, index, runs, options, 1, None, cancelled, progress, serial_batch_size)
    return None if outcome.status == CANCELED else outcome.solved
