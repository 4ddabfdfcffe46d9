"""The mean over all pairs of a run's matches, in blocks."""

from __future__ import annotations

import math
import random

from skyquad.operators import fit
from skyquad.operators.fit import pixels_per_degree


def _by_all(rows):
    out = {}
    for i, run in {(r[0], r[1]) for r in rows}:
        mine = [r[2:] for r in rows if r[:2] == (i, run)]
        found = []
        for q, x, y, a, d in mine:
            for p, u, v, b, e in mine:
                if q < p and (a, d) != (b, e) and (x, y) != (u, v):
                    ra, rb, d1, d2 = map(math.radians, (a, b, d, e))
                    cosine = math.sin(d1) * math.sin(d2) + math.cos(d1) * math.cos(d2) * math.cos(ra - rb)
                    found.append(math.hypot(x - u, y - v) / math.degrees(math.acos(max(-1, min(1, cosine)))))
        if found:
            out[i, run] = sum(found) / len(found)
    return out


def _rows(rng, n):
    spots = [(rng.uniform(0, 1600), rng.uniform(0, 1200), rng.uniform(10, 20), rng.uniform(-5, 5)) for _ in range(n * 3 // 4)]
    return [(1, run, q, *rng.choice(spots)) for run, k in ((0, n), (1, 5), (2, 1)) for q in range(k)] + [(1, 1, 3, *spots[0]), (1, 1, 3, *spots[1])]


def test_blocks_give_the_mean_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(fit, "_BLOCK", 40, raising=False)
    rows = _rows(random.Random(4), 150)
    matches = spark.createDataFrame(rows, "image_id long, run_id long, quad_id long, x double, y double, mid_ra double, mid_dec double").repartition(3)
    found = {(r.image_id, r.run_id): r.pixels_per_degree for r in pixels_per_degree(matches).collect()}
    want = _by_all(rows)
    assert found.keys() == want.keys()
    assert all(math.isclose(found[k], want[k], rel_tol=1e-9) for k in want)


def test_pairs_of_a_run_are_not_rows(spark):
    """All pairs of a run came out of one join as rows, in one task for each run."""
    rows = _rows(random.Random(4), 300)
    matches = spark.createDataFrame(rows, "image_id long, run_id long, quad_id long, x double, y double, mid_ra double, mid_dec double")
    plan = pixels_per_degree(matches)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "quad_id#" in plan and "BroadcastHashJoin" not in plan
