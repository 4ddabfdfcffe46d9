"""Slices of the blind queue: every run has one, and so has every place, held by a run or not."""

from __future__ import annotations

from conftest import SF

from skyquad import queries as engine
from skyquad.fixtures import fixture
from skyquad.plans import runs


def test_run_sectors_cover_the_whole_queue_and_all_centers(spark):
    found = engine.queries()["join_16_run_sectors"](spark, SF).collect()
    options = runs.BlindOptions(8.0, 2.0)
    queue = {r.run_id: r.ra for r in runs.blind_runs(spark, options).collect()}
    assert len(queue) == runs.ladder_sizes(options) == 7428
    assert {(r.run_id, r.sector) for r in found if r.run_id is not None} == {(i, max(0, -int(-ra // 60) - 1)) for i, ra in queue.items()}
    assert {r.place_id for r in found} - {None} == {r.run_id for r in fixture(spark, SF, "search_centers").collect()}


def test_places_meet_their_runs_and_none_is_lost(spark):
    queue = spark.createDataFrame([(0, 60.0, 0.0, 2.0), (1, 60.5, 0.0, 2.0), (2, 300.0, 80.0, 2.0)], "run_id long, ra double, dec double, radius double")
    places = spark.createDataFrame([(7, 60.1, 0.0), (7, 60.1, 0.0), (8, 0.0, -90.0), (9, None, None)], "place_id long, ra double, dec double")
    found = runs.sectors_at(queue, places, 6).collect()
    want = [(0, 0, 7, 1)] * 2 + [(1, 1, 7, 1)] * 2 + [(2, 4, None, None), (None, None, 8, 0)]
    missing = [r for r in found if r.place_id == 9]
    assert sorted(map(str, (tuple(r) for r in found if r.place_id != 9))) == sorted(map(str, want)) and len(missing) == 1 and missing[0].run_id is None
