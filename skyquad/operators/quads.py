"""Quads: a star and its three nearest neighbours, from pictures and from catalogs.

Neighbours are found per group (a picture, or a subcell of a catalog pass) with array operations on its
stars and those in the squares around them, so that a group takes time in proportion to its stars; groups
are dealt out by Spark. Everything else is a column expression.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratios import quad_ratios, quantized
from ..functions.sphere import angular_distance, unit_vector, vector_position

PASSES = 4
_BLOCK = 512
_FEW = 200  # places of which all distances are computed
_PAIRED = 1 << 20  # places and points around them that are compared at once, unless one place has more
_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def median_size(stars: DataFrame) -> DataFrame:
    """image_id and median_size. For even counts the two stars *above* the middle are averaged, as
    in the original; two stars, where that runs out of bounds, take their mean."""
    order = Window.partitionBy("image_id").orderBy("size", "star_id")
    ranked = stars.select("image_id", "size", (F.row_number().over(order) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("image_id")).alias("n"))
    mid = F.floor(F.col("n") / 2)
    wanted = F.when(F.col("n") % 2 == 1, F.col("i") == mid).when(F.col("n") == 2, F.lit(True)).otherwise(F.col("i").isin(mid, mid + 1))
    return ranked.filter(wanted).groupBy("image_id").agg(F.avg("size").alias("median_size"))


def max_stars(n: Column) -> Column:
    """300, or a third of the stars if that is more, 1000 at most."""
    third = n * 0.33
    return F.when(third <= 300, F.lit(300).cast("long")).otherwise(F.floor(F.least(third, F.lit(1000e0))))


def brightest(stars: DataFrame, limit: int | None = None) -> DataFrame:
    """The brightest stars of each picture, with their rank (from 1). ``stars``: image_id,
    star_id, x, y, brightness, size. Larger than usual stars count as slightly brighter; ties go
    to the smaller star_id. Pictures are many and hold some thousand stars each, so the medians
    join back by image_id."""
    sized = stars.join(median_size(stars), "image_id")
    bonus = F.col("size") / F.nullif("median_size", F.lit(0e0)) * 50e0
    adjusted = F.when(F.col("size") <= F.col("median_size"), F.col("brightness").cast("double")).otherwise(F.col("brightness") + F.coalesce(bonus, F.lit(0e0)))
    whole = Window.partitionBy("image_id")
    ranked = sized.withColumn("adjusted", adjusted).withColumns({
        "rank": F.row_number().over(whole.orderBy(F.desc("adjusted"), "star_id")),
        "n": F.count(F.lit(1)).over(whole),
    })
    limits = F.lit(limit) if limit is not None else max_stars(F.col("n"))
    return ranked.filter(F.col("rank") <= limits).drop("n", "median_size")


def _plane(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dx, dy = a[..., 0] - b[..., 0], a[..., 1] - b[..., 1]
    return np.sqrt(dx * dx + dy * dy)


def _sphere(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    ra1, d1, ra2, d2 = (np.radians(p[..., i]) for p in (a, b) for i in (0, 1))
    cosine = np.sin(d1) * np.sin(d2) + np.cos(d1) * np.cos(d2) * np.cos(ra1 - ra2)
    apart = np.degrees(np.arccos(np.clip(cosine, -1, 1)))
    return np.where((a == b).all(axis=-1), 0, apart)


def _seen_flat(points: np.ndarray) -> np.ndarray:
    """Places on the sky, in degrees on the plane that touches it at their middle, straight from above:
    never farther apart there than on the sky."""
    ra, dec = np.radians(points[:, 0]), np.radians(points[:, 1])
    v = np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)], axis=1)
    middle = v.mean(axis=0)
    norm = np.sqrt((middle * middle).sum())
    up = middle / norm if norm > 1e-9 else np.array([0.0, 0.0, 1.0])
    side = np.cross(up, np.eye(3)[np.abs(up).argmin()])
    side /= np.sqrt((side * side).sum())
    return np.degrees(v @ np.stack([side, np.cross(up, side)], axis=1))


#: Rounding of the cosine, in square degrees: what lies farther off than another by less may come out nearer.
_SLACK = {_plane: 0.0, _sphere: 1e-13 * (180 / np.pi) ** 2}


def nearest_three(points: np.ndarray, distance: Callable) -> np.ndarray:
    """Rows of (index, its three nearest at a distance over 0); ties go to the lower index. Points
    without three such neighbours have no row."""
    if len(points) <= 3:
        return np.empty((0, 4), dtype=np.int64)
    if len(points) <= _FEW or not np.isfinite(points).all():
        three = _three_of_all(points, points, distance)
    else:
        # Points at one place have the same neighbours, and no point has more than three from one place.
        places, of = np.unique(points, axis=0, return_inverse=True)
        of = of.reshape(-1)
        order = np.argsort(of, kind="stable")
        nth = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        kept = np.sort(order[nth < 3])
        nearest = _three_of_all if len(places) <= _FEW else _three_of_grid
        three = nearest(places, points[kept], distance)
        three = np.where(three < 0, -1, kept[three])[of]
    mine = np.flatnonzero((three >= 0).all(axis=1))
    return np.concatenate([mine[:, None], three[mine]], axis=1)


def _three_of_all(places: np.ndarray, points: np.ndarray, distance: Callable) -> np.ndarray:
    """Of each place the three nearest points, -1 where there are no more, by all distances."""
    found = []
    for start in range(0, len(places), _BLOCK):
        apart = distance(places[start : start + _BLOCK, None, :], points[None, :, :])
        apart[apart <= 0] = np.inf
        mine, picked = np.arange(len(apart)), []
        for _ in range(3):
            best = apart.argmin(axis=1)
            picked.append(np.where(np.isfinite(apart[mine, best]), best, -1))
            apart[mine, best] = np.inf
        found.append(np.stack(picked, axis=1))
    return np.concatenate(found)


def _three_of_grid(places: np.ndarray, points: np.ndarray, distance: Callable) -> np.ndarray:
    """The same, by the distances to what lies in the squares around each place alone. A place is settled once
    its third nearest is nearer than anything outside of them can be; the others are looked up in more squares."""
    flat = _seen_flat(np.concatenate([places, points])) if distance is _sphere else np.concatenate([places, points])
    low = flat.min(axis=0)
    flat = flat - low
    wide = flat.max(axis=0)
    size = max(np.sqrt(wide[0] * wide[1] * 2 / len(places)), wide.max() * 2 / len(places))
    if not size > 0:
        return _three_of_all(places, points, distance)
    square = (flat / size).astype(np.int64)
    across, up = square.max(axis=0) + 1
    mine, held = square[: len(places)], square[len(places) :]
    number = held[:, 1] * across + held[:, 0]
    order = np.argsort(number, kind="stable")
    first = np.searchsorted(number[order], np.arange(across * up + 1))
    three = np.full((len(places), 3), -1)
    left, reach = np.arange(len(places)), 1
    while len(left):
        x, y = mine[left, 0], mine[left, 1]
        rows = y[:, None] + np.arange(-reach, reach + 1)
        inside = (rows >= 0) & (rows < up)
        rows = np.where(inside, rows, 0) * across
        starts = first[rows + np.maximum(x - reach, 0)[:, None]]
        sizes = np.where(inside, first[rows + np.minimum(x + reach, across - 1)[:, None] + 1] - starts, 0)
        at = flat[left]
        # How far it is to the nearest edge beyond which there are squares at all.
        edges = [np.where(c - reach > 0, at[:, i] - (c - reach) * size, np.inf) for i, c in enumerate((x, y))]
        edges += [np.where(c + reach < n - 1, (c + reach + 1) * size - at[:, i], np.inf) for i, (c, n) in enumerate(((x, across), (y, up)))]
        gap = np.minimum.reduce(edges) - 1e-9 * size
        settled = np.zeros(len(left), dtype=bool)
        for part in np.split(np.arange(len(left)), np.flatnonzero(np.diff(np.cumsum(sizes.sum(axis=1)) // _PAIRED)) + 1):
            n = sizes[part].ravel()
            if not n.sum():
                settled[part] = np.isinf(gap[part])
                continue
            ends = np.cumsum(n)
            near = order[np.arange(ends[-1]) + np.repeat(starts[part].ravel() - (ends - n), n)]
            per = sizes[part].sum(axis=1)
            of = np.repeat(np.arange(len(part)), per)
            apart = distance(places[left[part]][of], points[near])
            some = apart > 0
            of, near, apart = of[some], near[some], apart[some]
            rank = np.lexsort((near, apart, of))
            of, near, apart = of[rank], near[rank], apart[rank]
            nth = np.arange(len(of)) - np.searchsorted(of, of)
            best, third = np.full((len(part), 3), -1), np.full(len(part), np.inf)
            best[of[nth < 3], nth[nth < 3]] = near[nth < 3]
            third[of[nth == 2]] = apart[nth == 2]
            three[left[part]] = best
            settled[part] = np.isinf(gap[part]) | ((gap[part] > 0) & (third * third * (1 + 1e-9) + _SLACK[distance] < gap[part] * gap[part]))
        left, reach = left[~settled], reach * 2
    return three


def _first_of_each(rows: np.ndarray) -> np.ndarray:
    """Positions of the first row of every set of stars, ascending."""
    if not len(rows):
        return np.empty(0, dtype=np.int64)
    _, first = np.unique(np.sort(rows, axis=1), axis=0, return_index=True)
    return np.sort(first)


def _columns(rows: np.ndarray, ids: np.ndarray, points: np.ndarray) -> dict[str, np.ndarray]:
    """Star ids and both coordinates of the four stars of each row."""
    out = {f"s{k}": ids[rows[:, k]] for k in range(4)}
    return out | {f"{c}{k}": points[rows[:, k], j] for j, c in enumerate("uv") for k in range(4)}


_FOUR = ", ".join([f"s{k} long" for k in range(4)] + [f"{c}{k} double" for c in "uv" for k in range(4)])


def _picture_groups(stars: pd.DataFrame) -> pd.DataFrame:
    stars = stars.sort_values("rank")
    points, ids = stars[["x", "y"]].to_numpy(float), stars["star_id"].to_numpy()
    passes = [nearest_three(points[: int(len(points) * (1 - p * 0.05))], _plane) for p in range(PASSES)]
    every = np.concatenate(passes)
    first = _first_of_each(every)
    rows, numbers = every[first], np.repeat(np.arange(PASSES), [len(p) for p in passes])[first]
    return pd.DataFrame({
        "image_id": np.full(len(rows), stars["image_id"].iloc[0]),
        "seq": np.arange(len(rows)),
        "pass": numbers.astype(np.int32),
    } | _columns(rows, ids, points))


def _star_ids() -> Column:
    return F.array(*[F.col(f"s{k}") for k in range(4)]).alias("star_ids")


def picture_quads(stars: DataFrame) -> DataFrame:
    """Distinct quads of the chosen stars of each picture (columns of ``brightest``): image_id,
    quad_id (position by r0), pass (the first that has it), r0..r4, largest, mid_x, mid_y,
    star_ids, and n_first, the picture's number of distinct quads in the first pass."""
    groups = stars.select("image_id", "star_id", "x", "y", "rank").groupBy("image_id")
    found = groups.applyInPandas(_picture_groups, f"image_id long, seq long, pass int, {_FOUR}")
    x, y = [F.col(f"u{i}") for i in range(4)], [F.col(f"v{i}") for i in range(4)]
    sides = F.array(*[F.sqrt((x[i] - x[j]) * (x[i] - x[j]) + (y[i] - y[j]) * (y[i] - y[j])) for i, j in _PAIRS])
    ratios, largest = quad_ratios(sides)
    found = found.withColumns({"ratios": ratios, "largest": largest, "mid_x": sum(x[1:], x[0]) / 4e0, "mid_y": sum(y[1:], y[0]) / 4e0})
    whole = Window.partitionBy("image_id")
    return found.withColumns({
        "quad_id": F.row_number().over(whole.orderBy(F.col("ratios")[0], "seq")).cast("long") - 1,
        "n_first": F.sum((F.col("pass") == 0).cast("long")).over(whole),
    }).select("image_id", "quad_id", "pass", *[F.col("ratios")[i].alias(f"r{i}") for i in range(5)], "largest", "mid_x", "mid_y", _star_ids(), "n_first")


def _catalog_groups(key: tuple, stars: pd.DataFrame) -> pd.DataFrame:
    stars = stars.sort_values("rank")
    points, ids = stars[["ra", "dec"]].to_numpy(float), stars["star_id"].to_numpy()
    rows = nearest_three(points, _sphere) if len(points) > 4 else np.empty((0, 4), dtype=np.int64)
    rows = rows[_first_of_each(rows)]
    out = pd.DataFrame(_columns(rows, ids, points))
    for name, value in zip(("cell_id", "pass", "subcell"), key, strict=True):
        out[name] = value
    out["pos"] = np.arange(len(rows))
    return out


def catalog_quads(stars: DataFrame) -> DataFrame:
    """Quads of the stars of each subcell: cell_id, pass, subcell, pos, r0..r4 (as the packed form
    keeps them), largest, mid_ra, mid_dec, star_ids. ``stars``: cell_id, pass, subcell, star_id,
    rank (brightest first), ra, dec. A subcell forms quads from more than four stars; quads of the
    same stars count once, the first by rank."""
    # By number: Spark would put groups together by their bytes, of which there are few for the work they make.
    parts = int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stars.select("cell_id", "pass", "subcell", "star_id", "rank", "ra", "dec").repartition(parts, "cell_id", "pass", "subcell")
    groups = dealt.groupBy("cell_id", "pass", "subcell")
    found = groups.applyInPandas(_catalog_groups, f"{_FOUR}, cell_id string, pass int, subcell int, pos long")
    ra, dec = [F.col(f"u{i}") for i in range(4)], [F.col(f"v{i}") for i in range(4)]
    sides = F.array(*[angular_distance(ra[i], dec[i], ra[j], dec[j]) for i, j in _PAIRS])
    ratios, largest = quad_ratios(sides)
    vectors = [unit_vector(r, d) for r, d in zip(ra, dec, strict=True)]
    middle = vector_position(*[sum(v[1:], v[0]) / 4e0 for v in zip(*vectors, strict=True)])
    found = found.withColumns({"ratios": ratios, "largest": largest})
    levels = quantized([F.col("ratios")[i] for i in range(5)])
    return found.select(
        "cell_id", "pass", "subcell", "pos", *[v.alias(f"r{i}") for i, v in enumerate(levels)], "largest",
        middle[0].cast("float").alias("mid_ra"), middle[1].cast("float").alias("mid_dec"), _star_ids(),
    )
