"""Searches in stages that run at once, time out, are cancelled and tell how far they are."""

from __future__ import annotations

import threading
import time

import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_pictures import built  # noqa: F401  a fixture

from skyquad import storage
from skyquad.fixtures import CENTER, fixture, pictures
from skyquad.plans import runs, search, solve
from skyquad.sinks import results

STAGES = lambda n: 40  # noqa: E731  runs in a stage: several stages for the short plans of tests


@pytest.fixture(scope="module")
def asked(spark):
    """Two pictures of the planted stars, and a plan whose first circles see nothing."""
    stars = fixture(spark, SF, "image_stars")
    both = storage.stash(stars.unionByName(stars.withColumn("image_id", F.lit(2).cast("long"))), "stars")
    sizes = spark.createDataFrame([(1, 1600, 1200), (2, 1600, 1200)], "image_id long, width long, height long")
    around = runs.nearby_runs(spark, runs.NearbyOptions(ra=24.0, dec=4.0, max_field_radius=5.7, search_radius=14.0))
    return both, sizes, storage.stash(around, "plan")


def jobs_left(spark):
    return list(spark.sparkContext.statusTracker().getActiveJobsIds())


def test_the_winner_is_the_same_however_many_stages_run_at_once(spark, built, asked):  # noqa: F811
    stars, sizes, plan = asked
    heard: dict[int, list] = {1: [], 4: []}
    found = {}
    for parallel in (1, 4):
        tell = lambda step, facts, to=heard[parallel]: to.append((step, facts))
        outcome = search.search_staged(stars, sizes, built, plan, solve.SolveOptions(sampling=2), parallel, None, None, tell, batches=lambda n: 6)
        assert (outcome.status, outcome.pictures, outcome.n_solved) == (search.SUCCESS, 2, 2)
        found[parallel] = sorted((r.image_id, r.run_id, round(r.ra, 6), round(r.dec, 6), r.n_matches) for r in outcome.solved.collect())
        assert jobs_left(spark) == []
    assert found[1] == found[4] and len(found[1]) == 2
    assert all(abs(r[2] - CENTER[0]) < 0.05 and abs(r[3] - CENTER[1]) < 0.05 for r in found[1])
    rows = search.result_rows(outcome, stars, sizes, plan)
    shown = {r.image_id: __import__("json").loads(r.json) for r in results.as_json(rows, extended=True).collect()}
    assert shown[1]["success"] and shown[1]["starsDetected"] >= shown[1]["starsUsed"] > 8 and shown[1]["searchIterations"] == outcome.areas >= 6 and shown[1]["timeSpent"].startswith("00:0")
    assert shown[1]["searchRunCenter"].startswith("[") and shown[1]["searchRunRadius"] > 5 and shown[1]["quadMatches"] >= 8 and shown[1]["imageWidth"] == 1600
    for told in heard.values():
        steps = [s for s, _ in told]
        assert steps[:3] == ["quad_formation_started", "quad_formation_finished", "solve_process_started"] and steps[-1] == "solve_process_finished"
        assert set(steps) - {"batch_done"} <= set(search.STEPS)
        facts = dict(told[:-1])["quad_formation_finished"]
        assert facts["pictures"] == 2 and facts["quads"] > 0 and facts["pairs"] > 0
        assert told[-1][1] == {"status": "Success", "pictures": 2, "solved": 2, "stages": steps.count("batch_done")}
        assert sum(f["solved"] for s, f in told if s == "batch_done") == 2


def test_a_timeout_ends_a_search_inside_a_stage(spark, built, asked, monkeypatch):  # noqa: F811
    """A stage that would take minutes is ended within seconds, its jobs with it."""
    stars, sizes, plan = asked
    began = threading.Event()

    def slow(*args, **kwargs):
        began.set()
        rows = spark.range(0, 8, 1, 4).mapInPandas(lambda batches: (time.sleep(60) or b for b in batches), "id long")
        return rows.select(F.col("id").alias("image_id"), F.col("id").alias("run_id"), F.col("id").alias("n_potential"))

    monkeypatch.setattr(search, "count_potential", slow)
    start = time.monotonic()
    outcome = search.search_staged(stars, sizes, built, plan, solve.SolveOptions(sampling=1), 2, timeout=25, batches=lambda n: 6)
    assert began.is_set() and outcome.status == search.TIMEOUT and outcome.n_solved == 0 and outcome.solved.count() == 0
    assert time.monotonic() - start < 35 and jobs_left(spark) == []


def test_a_search_is_cancelled_while_it_forms_quads_or_solves(spark, built, asked, monkeypatch):  # noqa: F811
    stars, sizes, plan = asked
    assert search.solve_staged(stars, sizes, built, plan, cancelled=lambda: True) is None
    wish = threading.Event()
    real = search.run_stage

    def stage(check, *args):
        wish.set()  # as soon as a stage is at work
        return real(check, *args)

    monkeypatch.setattr(search, "run_stage", stage)
    outcome = search.search_staged(stars, sizes, built, plan, solve.SolveOptions(sampling=1), 2, cancelled=wish.is_set, batches=lambda n: 6)
    assert outcome.status == search.CANCELED and outcome.stages == 0 and jobs_left(spark) == []


def test_an_error_in_a_stage_is_raised(spark, built, asked, monkeypatch):  # noqa: F811
    stars, sizes, plan = asked
    monkeypatch.setattr(search, "run_stage", lambda *a: (_ for _ in ()).throw(ZeroDivisionError("planted")))
    with pytest.raises(ZeroDivisionError):
        search.search_staged(stars, sizes, built, plan, parallel=2)
    assert jobs_left(spark) == []


def test_a_search_that_finds_nothing(spark, built, asked):  # noqa: F811
    stars, sizes, _ = asked
    outcome = search.search_staged(stars, sizes, built, runs.point_runs(spark, 200.0, -60.0, 3.0), solve.SolveOptions(sampling=1))
    assert (outcome.status, outcome.pictures, outcome.n_solved, outcome.solved.count()) == (search.FAILURE, 2, 0, 0)
    assert outcome.solved.columns[: len(solve.SOLUTION)] == solve.SOLUTION
    none = search.search_staged(stars.limit(0), sizes.limit(0), built, runs.point_runs(spark, 18.0, 0.5, 5.7))
    assert (none.status, none.pictures) == (search.SUCCESS, 0)


def test_stages_follow_the_plan(spark):
    table = spark.createDataFrame([(i, 1 if i < 2500 else 2) for i in range(6000)], "run_id long, radius_group int")
    stages = search.plan_stages(table, 2)
    assert [(s.subset, s.radius_group, s.low, s.high) for s in stages[:5]] == [(0, 1, 0, 1000), (0, 1, 1000, 2000), (0, 1, 2000, 3000), (0, 2, 2500, 5000), (0, 2, 5000, 7500)]
    assert [s.number for s in stages] == list(range(10)) and len(search.plan_stages(table, 1, search.serial_batch_size)) == 7
    assert [search.batch_size(n) for n in (1, 2_999, 3_000, 24_999, 25_000)] == [1000, 1000, 2500, 2500, 4000]


def test_tables_are_observed_counted_and_removed(spark):
    before = spark.conf.get(storage._CLEANUP, None)
    found = storage.stash_observed(spark.range(100), "numbers", even=F.count_if(F.col("id") % 2 == 0))
    assert found.facts == {"n": 100, "even": 50} and found.table.count() == 100
    assert storage.stash_observed(spark.range(5).filter("id > 9"), "none").facts == {"n": 0}
    errors = []

    def many():
        try:
            for _ in range(3):
                storage.stash(spark.range(10), "from-a-thread")
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=many) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and spark.conf.get(storage._CLEANUP, None) == before
    assert pictures(spark).count() == 1


def test_tables_of_an_application_can_be_removed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "shared_folder", lambda s: f"file://{tmp_path}")
    table = storage.stash(spark.range(3), "gone-later")
    assert table.count() == 3
    storage.remove_tables(spark)
    assert list(tmp_path.iterdir()) == []
