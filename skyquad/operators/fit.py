"""Least-squares plate constants, with a leave-one-out clip in closed form.

The normal equations are sums over the matches of a run, so leaving one match out is subtracting
its own terms: one window pass in place of a fit per match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sphere import angular_distance, to_plane

KEY = ["image_id", "run_id"]
CONSTANTS = list("abcdef")
LEAST_KEPT = 8
_PLACE = ["x", "y", "mid_ra", "mid_dec"]
_BLOCK = 2048  # matches of a run that meet those of another block in one row
_AT_ONCE = 1 << 17  # pairs that are computed at once, unless one block has more
#: Allowed scale deviation, in sigmas, at small and large median scale ratios.
SIGMA_RANGE, RATIO_RANGE = (0.66, 2.0), (300.0, 1500.0)


def _run():
    return Window.partitionBy(*KEY)


def terms(x: Column, y: Column, u: Column, v: Column) -> dict[str, Column]:
    """A match's share of the sums: pixel (x, y), standard coordinates (u, v)."""
    one = F.lit(1e0)
    return {"n": one, "x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y, "u": u, "xu": x * u, "yu": y * u, "v": v, "xv": x * v, "yv": y * v}


def add_constants(df: DataFrame, sums: dict[str, Column], prefix: str = "") -> DataFrame:
    """Adds a..f: ``p x + q y + r + w`` with the least squares, for w = u and w = v, by cofactors of
    the symmetric normal matrix; null where the points lie on a line."""
    s = {k: F.col(f"_{prefix}{k}") for k in sums}
    out = df.withColumns({f"_{prefix}{k}": v for k, v in sums.items()})
    cofactors = {
        "00": s["yy"] * s["n"] - s["y"] * s["y"],
        "01": s["x"] * s["y"] - s["xy"] * s["n"],
        "02": s["xy"] * s["y"] - s["yy"] * s["x"],
        "11": s["xx"] * s["n"] - s["x"] * s["x"],
        "12": s["xy"] * s["x"] - s["xx"] * s["y"],
        "22": s["xx"] * s["yy"] - s["xy"] * s["xy"],
    }
    out = out.withColumns({f"_{prefix}c{k}": v for k, v in cofactors.items()})
    c = {k: F.col(f"_{prefix}c{k}") for k in cofactors} | {k[::-1]: F.col(f"_{prefix}c{k}") for k in cofactors}
    out = out.withColumn(f"_{prefix}det", s["xx"] * c["00"] + s["xy"] * c["01"] + s["x"] * c["02"])
    found = {}
    for names, w in (("abc", "u"), ("def", "v")):
        for row, name in enumerate(names):
            dot = c[f"{row}0"] * s["x" + w] + c[f"{row}1"] * s["y" + w] + c[f"{row}2"] * s[w]
            found[f"{prefix}{name}"] = F.try_divide(-dot, F.col(f"_{prefix}det"))
    extra = [f"_{prefix}{k}" for k in sums] + [f"_{prefix}c{k}" for k in cofactors] + [f"_{prefix}det"]
    return out.withColumns(found).drop(*extra)


def with_plane(matches: DataFrame) -> DataFrame:
    """Adds u, v: standard coordinates of the catalog midpoint around (ra0, dec0)."""
    u, v = to_plane("mid_ra", "mid_dec", "ra0", "dec0")
    return matches.withColumns({"u": u, "v": v})


def sigma_factor(median: Column) -> Column:
    (s0, s1), (r0, r1) = SIGMA_RANGE, RATIO_RANGE
    t = (median - r0) / (r1 - r0)
    return F.when(median <= r0, F.lit(s0)).when(median >= r1, F.lit(s1)).otherwise((F.lit(1e0) - t) * s0 + t * s1)


def influence(matches: DataFrame) -> DataFrame:
    """Adds d_a..d_f, the change of each constant when the match is left out, and d_scale, its
    distance from the median scale ratio."""
    own = terms(*[F.col(c) for c in ("x", "y", "u", "v")])
    totals = matches.withColumns({f"_s_{k}": F.sum(t).over(_run()) for k, t in own.items()})
    out = add_constants(totals, {k: F.col(f"_s_{k}") for k in own}, "all_")
    out = add_constants(out, {k: F.col(f"_s_{k}") - t for k, t in own.items()}, "less_")
    out = out.withColumns({f"d_{c}": F.col(f"less_{c}") - F.col(f"all_{c}") for c in CONSTANTS} | {"_median": F.median("scale_ratio").over(_run())})
    out = out.withColumn("d_scale", F.abs(F.col("_median") - F.col("scale_ratio")))
    return out.drop(*[f"_s_{k}" for k in own], *[f"{p}_{c}" for p in ("all", "less") for c in CONSTANTS])


def clip_influence(matches: DataFrame) -> DataFrame:
    """Drops matches that move a constant by over two sigmas or are off the median scale ratio; a
    run that would be left with fewer than eight keeps all of them."""
    moved = influence(matches)
    names = [f"d_{c}" for c in CONSTANTS]
    sigmas = {f"_t{n}": F.sqrt(F.avg(F.col(n) * F.col(n)).over(_run())) * 2e0 for n in names}
    sigmas["_td_scale"] = F.sqrt(F.avg(F.col("d_scale") * F.col("d_scale")).over(_run())) * sigma_factor(F.col("_median"))
    tested = moved.withColumns(sigmas)
    bad = F.lit(False)
    for n in [*names, "d_scale"]:
        bad = bad | F.coalesce(F.abs(F.col(n)) > F.col(f"_t{n}"), F.lit(False))
    tested = tested.withColumn("_good", ~bad).withColumn("_left", F.sum(F.col("_good").cast("int")).over(_run()))
    return tested.filter((F.col("_left") < LEAST_KEPT) | F.col("_good")).drop(*sigmas, *names, "d_scale", "_good", "_left", "_median")


def match_pairs(matches: DataFrame) -> DataFrame:
    """Pairs of a run's matches, as ``m`` and ``o``."""
    side = matches.select(*KEY, "quad_id", "x", "y", "mid_ra", "mid_dec")
    return side.alias("m").join(side.alias("o"), KEY).filter("m.quad_id < o.quad_id")


def _dense(matches: DataFrame) -> DataFrame:
    """Matches at one place of picture and sky as one row with their number, ``weight``. ``own`` is the
    quad_id of those that share it with another match of the run, which isn't paired with them."""
    side = matches.select(*KEY, "quad_id", *[F.col(c).cast("double").alias(c) for c in _PLACE]).dropna()
    shared = F.count(F.lit(1)).over(Window.partitionBy(*KEY, "quad_id")) > 1
    side = side.withColumn("own", F.when(shared, F.col("quad_id").cast("long")))
    return side.groupBy(*KEY, *_PLACE, "own").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def _ratio_sums(a: dict[str, np.ndarray], b: dict[str, np.ndarray], same: bool) -> tuple[float, float]:
    """Sum of pixels by degrees, and number, of the pairs of two blocks, or of one block in itself."""
    total = pairs = 0.0
    step = max(1, _AT_ONCE // len(b["x"]))
    for start in range(0, len(a["x"]), step):
        m = {k: v[start : start + step, None] for k, v in a.items()}
        dx, dy = m["x"] - b["x"], m["y"] - b["y"]
        pixels = np.sqrt(dx * dx + dy * dy)
        cosine = m["sin"] * b["sin"] + m["cos"] * b["cos"] * np.cos(m["ra"] - b["ra"])
        degrees = np.degrees(np.arccos(np.fmax(-1e0, np.fmin(1e0, cosine))))
        weight = m["weight"] * b["weight"]
        out = (pixels <= 0) | (degrees <= 0) | ((m["mid_ra"] == b["mid_ra"]) & (m["mid_dec"] == b["mid_dec"])) | (m["own"] == b["own"])
        if same:
            out |= np.arange(start, start + len(pixels))[:, None] >= np.arange(len(b["x"]))
        weight[out], degrees[out] = 0.0, 1.0
        total += float((pixels / degrees * weight).sum())
        pairs += float(weight.sum())
    return total, pairs


def _block(rows: pa.StructScalar) -> dict[str, np.ndarray]:
    found = {f.name: rows.values.field(f.name) for f in rows.type.value_type}
    out = {k: v.to_numpy(zero_copy_only=False).astype(float) for k, v in found.items() if k != "own"}
    # Without an own quad_id a match is unlike any, also itself. Whole numbers are compared, not rounded ones.
    out["own"] = np.array([object() if v is None else v for v in found["own"].to_pylist()], dtype=object) if found["own"].null_count < len(found["own"]) else np.full(len(found["own"]), np.nan)
    ra, dec = np.radians(out["mid_ra"]), np.radians(out["mid_dec"])
    return out | {"ra": ra, "sin": np.sin(dec), "cos": np.cos(dec)}


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = []
        for i, j, left, right in zip(*(batch.column(c) for c in ("i", "j", "left", "right")), strict=True):
            same = i.as_py() == j.as_py()
            a = _block(left)
            sums.append(_ratio_sums(a, a if same else _block(right), same))
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in KEY], *[pa.array([s[n] for s in sums], pa.float64()) for n in (0, 1)]], [*KEY, "total", "pairs"])


def pixels_per_degree(matches: DataFrame) -> DataFrame:
    """Per run, the mean over pairs of matches of their distance in pixels and degrees. Matches at one place
    count as one with a weight. A run of many is cut into blocks, and each pair of blocks is a row of its
    own: memory is bounded by blocks, and one run's pairs are dealt to all tasks."""
    parts = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _dense(matches).withColumn("_n", F.ceil(F.count(F.lit(1)).over(_run()) / _BLOCK))
    place = F.struct(*_PLACE, "own", "weight")
    blocks = rows.withColumn("_b", F.pmod(F.xxhash64(*_PLACE), "_n")).groupBy(*KEY, "_n", "_b").agg(F.collect_list(place).alias("rows"))
    keys = [*KEY, "i", "j"]
    left = blocks.select(*KEY, F.col("_b").alias("i"), F.explode(F.sequence("_b", F.col("_n") - 1)).alias("j"), F.col("rows").alias("left")).repartition(parts, *keys)
    right = blocks.select(*KEY, F.explode(F.sequence(F.lit(0).cast("long"), "_b")).alias("i"), F.col("_b").alias("j"), F.col("rows").alias("right")).repartition(parts, *keys)
    met = left.join(right.hint("merge"), keys).select(*keys, "left", "right")
    types = {f.name: f.dataType.simpleString() for f in matches.schema}
    sums = met.mapInArrow(_paired, ", ".join([*[f"{k} {types[k]}" for k in KEY], "total double", "pairs double"]))
    summed = sums.groupBy(*KEY).agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs")).filter("pairs > 0")
    return summed.select(*KEY, (F.col("total") / F.col("pairs")).alias("pixels_per_degree"))


def fit_plates(matches: DataFrame) -> DataFrame:
    """Plate constants of each run: image_id, run_id, ra0, dec0, a..f, n_matches."""
    own = terms(*[F.col(c) for c in ("x", "y", "u", "v")])
    sums = matches.groupBy(*KEY).agg(F.first("ra0").alias("ra0"), F.first("dec0").alias("dec0"), F.count(F.lit(1)).alias("n_matches"), *[F.sum(t).alias(f"_s_{k}") for k, t in own.items()])
    return add_constants(sums, {k: F.col(f"_s_{k}") for k in own}).drop(*[f"_s_{k}" for k in own])
