"""Quads of many stars: as many distances as stars, not as pairs of them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquad.functions.ratios import quad_ratios
from skyquad.operators import quads


def _by_all(points, distance):
    apart = distance(points[:, None, :], points[None, :, :])
    out = []
    for i, row in enumerate(apart):
        near = sorted((d, j) for j, d in enumerate(row) if d > 0)[:3]
        if len(near) == 3:
            out.append([i, *[j for _, j in near]])
    return np.array(out).reshape(-1, 4)


def _skies():
    rng = np.random.default_rng(5)
    flat = np.stack([rng.uniform(10, 11, 700), rng.uniform(-0.5, 0.5, 700)], axis=1).astype(np.float32).astype(float)
    yield "spread", flat
    yield "lattice", np.round(flat, 1)
    yield "copies", flat[rng.integers(0, 30, 700)]
    yield "pole", np.stack([rng.uniform(0, 360, 700), 90 - rng.uniform(0, 4, 700)], axis=1)
    yield "crowd", np.concatenate([flat[:9] * 5, np.array([12.0, 0.2]) + rng.normal(0, 1e-4, (691, 2))])
    yield "line", np.stack([rng.uniform(0, 9, 700), np.full(700, 3.0)], axis=1)


@pytest.mark.parametrize("distance", [quads._plane, quads._sphere])
@pytest.mark.parametrize(("name", "points"), list(_skies()))
def test_nearest_three_are_those_of_all_distances(name, points, distance):
    assert quads.nearest_three(points, distance).tolist() == _by_all(points, distance).tolist()


def test_distances_grow_with_the_stars(monkeypatch):
    rng, taken, arccos = np.random.default_rng(5), [], np.arccos
    monkeypatch.setattr(np, "arccos", lambda x: taken.append(np.size(x)) or arccos(x))
    for n in (2000, 8000):
        found = quads.nearest_three(np.stack([rng.uniform(10, 11, n), rng.uniform(0, 1, n)], axis=1), quads._sphere)
        assert len(found) == n
        assert sum(taken) < 60 * n
        taken.clear()


def test_ratios_are_compiled(spark):
    """Functions of higher order aren't, and took most of the time of an index."""
    ratios, longest = quad_ratios(F.array(*[F.col("id") * k + k for k in (5.0, 1.0, 4.0, 2.0, 8.0, 3.0)]))
    df = spark.range(3).select(ratios.alias("ratios"), longest.alias("longest"))
    assert "lambda" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r.ratios) for r in df.collect()] == [(0.125, 0.25, 0.375, 0.5, 0.625)] * 3
