"""Star detection from pixels: histogram, background, connected components, shape filter.

Pixels in a table (image_id, x, y, v, a row per pixel) are joined: runs of bright pixels in a row to those of
the next row that they touch, and labels spread over these links by alternating star steps, so that no
picture has to fit into one task. Pictures whose samples are in one value do lie in one task: there each is
decoded once, its threshold taken from its own histogram, and its runs are labelled where they are, so that
only bright pixels leave the task. Both ways give the same components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.fits import samples
from ..storage import stash

LEAST_PIXELS = 4
MOST_SHARE = 0.02
MOST_ASPECT = 6.0
LEAST_ROUNDNESS = 0.25
SMALL = 9


def histogram(pixels: DataFrame) -> DataFrame:
    """image_id, v, n."""
    return pixels.groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))


def histogram_peak(counts: DataFrame) -> DataFrame:
    """The most frequent value of each picture, the lowest of equals."""
    best = F.max(F.struct("n", (-F.col("v")).alias("low")))
    return counts.groupBy("image_id").agg(best.alias("_b")).select("image_id", (-F.col("_b.low")).alias("peak"), F.col("_b.n").alias("n"))


def background(counts: DataFrame, offset: float = 3.0) -> DataFrame:
    """image_id, mean, std, flat from the histogram: whole-number mean, deviation around it,
    threshold. Pictures of mean 0 have no stars: they are left out."""
    sums = counts.groupBy("image_id").agg(
        F.sum("n").alias("count"), F.sum(F.col("n") * F.col("v")).alias("_1"), F.sum(F.col("n") * F.col("v") * F.col("v")).alias("_2")
    )
    sums = sums.withColumn("mean", F.floor(F.col("_1") / F.col("count")).cast("long"))
    around = F.col("_2") - F.col("mean") * F.col("_1") * 2 + F.col("mean") * F.col("mean") * F.col("count")
    out = sums.withColumn("std", F.sqrt(around.cast("double") / F.col("count")))
    flat = F.col("mean") + F.floor(F.col("std") * offset).cast("long")
    return out.filter("mean <> 0").select("image_id", "mean", "std", flat.alias("flat"))


def bright_pixels(pixels: DataFrame, levels: DataFrame) -> DataFrame:
    """Pixels above their picture's threshold. ``levels`` has a row per picture."""
    return pixels.join(levels.select("image_id", "flat"), "image_id").filter(F.col("v") > F.col("flat")).drop("flat")


def pixel_runs(bright: DataFrame) -> DataFrame:
    """image_id, y, left, right of consecutive bright pixels of a row."""
    order = Window.partitionBy("image_id", "y").orderBy("x")
    islands = bright.withColumn("_island", F.col("x") - F.row_number().over(order))
    return islands.groupBy("image_id", "y", "_island").agg(F.min("x").alias("left"), F.max("x").alias("right")).drop("_island")


def run_links(runs: DataFrame) -> DataFrame:
    """Pairs of runs that touch in neighbouring rows, corners included. ``runs`` has run (an id)."""
    above = runs.select("image_id", (F.col("y") + 1).alias("y"), F.col("left").alias("l2"), F.col("right").alias("r2"), F.col("run").alias("a"))
    pairs = runs.join(above, ["image_id", "y"]).filter((F.col("l2") <= F.col("right") + 1) & (F.col("r2") >= F.col("left") - 1))
    return pairs.select("image_id", "a", F.col("run").alias("b"))


def spread_labels(runs: DataFrame, links: DataFrame) -> DataFrame:
    """image_id, run, component: the least run of each connected set. Large-star and small-star
    steps over the links; the number of rounds is logarithmic in a component's extent."""

    def least(edges: DataFrame) -> DataFrame:
        return edges.groupBy("image_id", "a").agg(F.min("b").alias("m"))

    edges = stash(links.select("image_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("image_id", "a", "b").cast("decimal(38,0)"))).first()
        if not mark[0] or tuple(mark) == before:
            break
        before = tuple(mark)
        both = edges.unionByName(edges.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))
        low = least(both).select("image_id", "a", F.least("a", "m").alias("m"))
        large = both.join(low, ["image_id", "a"]).filter("b > a").select("image_id", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = least(large)
        moved = large.join(low, ["image_id", "a"]).filter("b <> m").select("image_id", F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stash(moved.unionByName(low.select("image_id", "a", F.col("m").alias("b"))).filter("a <> b").distinct(), "links")
    named = edges.select("image_id", F.col("a").alias("run"), F.col("b").alias("root"))
    return runs.join(named, ["image_id", "run"], "left").select("image_id", "run", F.coalesce("root", "run").alias("component"))


def numbered_runs(bright: DataFrame) -> DataFrame:
    """Runs with an id that orders them by row and column within their picture."""
    return pixel_runs(bright).withColumn("run", F.shiftleft("y", 32) + F.col("left"))


def component_pixels(bright: DataFrame) -> DataFrame:
    """image_id, x, y, v, component of every bright pixel (8-connectivity)."""
    runs = stash(numbered_runs(bright), "pixel-runs")
    labels = spread_labels(runs, run_links(runs))
    placed = runs.join(labels, ["image_id", "run"]).select("image_id", "y", F.explode(F.sequence("left", "right")).alias("x"), "component")
    return bright.join(placed, ["image_id", "y", "x"])


def measure_components(labelled: DataFrame) -> DataFrame:
    """Bounding box, size, center and brightness of each component. Up to nine pixels the center is
    the box's; beyond, that of the box around the brighter half (pixels by value, then row, column)."""
    by = ["image_id", "component"]
    whole = Window.partitionBy(*by)
    ranked = labelled.withColumns({"_i": F.row_number().over(whole.orderBy("v", "y", "x")) - 1, "_n": F.count(F.lit(1)).over(whole)})
    bright = (F.col("_n") <= SMALL) | (F.col("_i") >= F.ceil(F.col("_n") * 0.5))

    def half(c: str) -> tuple[Column, Column]:
        picked = F.when(bright, F.col(c))
        return F.min(picked).alias(f"_{c}0"), F.max(picked).alias(f"_{c}1")

    out = ranked.groupBy(*by).agg(
        F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom"),
        F.count(F.lit(1)).alias("n_pixels"), F.count_distinct("y").alias("height"), F.max("v").alias("brightness"), *half("x"), *half("y"),
    )
    wide, high = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    return out.select(
        *by, "left", "right", "top", "bottom", "n_pixels", "height", (wide + 1).alias("width"),
        (F.col("_x0") + (F.col("_x1") - F.col("_x0")) * 0.5).alias("x"), (F.col("_y0") + (F.col("_y1") - F.col("_y0")) * 0.5).alias("y"),
        "brightness", F.sqrt((wide * wide + high * high).cast("double")).alias("size"),
    )


def too_small() -> Column:
    return F.col("n_pixels") < LEAST_PIXELS


def too_large(image_width: Column, image_height: Column) -> Column:
    most = F.floor(F.greatest(image_width, image_height) * MOST_SHARE)
    return (F.col("width") > most) | (F.col("height") > most)


def streak() -> Column:
    wide, high = F.col("width").cast("float"), F.col("height").cast("float")
    return (wide == 1) | (high == 1) | ((wide / high).cast("float") >= MOST_ASPECT) | ((high / wide).cast("float") >= MOST_ASPECT)


def not_round() -> Column:
    across = F.greatest("width", "height").cast("double") * math.pi
    return F.col("n_pixels") * (4 * math.pi) / (across * across) < LEAST_ROUNDNESS


def star_shape(image_width: Column, image_height: Column) -> Column:
    """The usual filter; any other function of the picture's size to a condition will do instead."""
    return ~too_small() & ~too_large(image_width, image_height) & ~streak() & ~not_round()


def filter_stars(components: DataFrame, sizes: DataFrame, shape: Callable[[Column, Column], Column] = star_shape) -> DataFrame:
    """Components that look like stars. ``sizes``: image_id, image_width, image_height."""
    sized = components.join(sizes, "image_id")
    return sized.filter(shape(F.col("image_width"), F.col("image_height"))).select(*components.columns)


def as_stars(components: DataFrame) -> DataFrame:
    return components.select("image_id", F.col("component").alias("star_id"), "x", "y", "brightness", "size")


def threshold(values: np.ndarray, offset: float) -> int | None:
    """As ``background`` has it, for one picture; None for a picture of mean 0."""
    levels, counts = np.unique(values, return_counts=True)
    n, first, second = len(values), 0, 0
    for v, c in zip(levels.tolist(), counts.tolist(), strict=True):  # whole numbers of any size
        first += v * c
        second += v * v * c
    mean = first // n if n else 0
    around = second - 2 * mean * first + mean * mean * n
    return mean + math.floor(math.sqrt(around / n) * offset) if mean else None


def label_runs(y: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For runs in the order of rows and columns, the first run of the component that each belongs to:
    least labels spread over touching runs, and over what they point to."""
    wide = int(right.max(initial=0)) + 4
    by_left, by_right = y * wide + left + 1, y * wide + right + 1
    low = np.searchsorted(by_right, (y - 1) * wide + left, "left")
    counts = np.maximum(np.searchsorted(by_left, (y - 1) * wide + right + 2, "right") - low, 0)
    below = np.repeat(np.arange(len(y)), counts)
    above = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(y) else low, counts) + np.arange(counts.sum())
    label = np.arange(len(y))
    while True:
        a, b = label[below], label[above]
        if np.array_equal(a, b):
            return label
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while not np.array_equal(label, further := label[label]):
            label = further


def _bright(offset: float):
    names = ["image_id", "x", "y", "v", "component"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, width, bits, data in zip(*[batch.column(c) for c in ("image_id", "width", "bits", "data")], strict=True):
                values = samples(data.as_buffer(), bits.as_py())
                flat = threshold(values, offset)
                if flat is None:
                    continue
                picture = values.reshape(-1, width.as_py())
                bright = np.zeros((len(picture), width.as_py() + 2), dtype=np.int8)
                bright[:, 1:-1] = picture > flat
                edges = np.diff(bright, axis=1)
                (y, left), right = np.nonzero(edges == 1), np.nonzero(edges == -1)[1] - 1
                root = label_runs(y, left, right)
                component = np.repeat((y[root] << 32) + left[root], right - left + 1)
                ys, xs = np.nonzero(bright[:, 1:-1])
                for at in range(0, len(ys), 1 << 18):
                    part = slice(at, at + (1 << 18))
                    v = picture[ys[part], xs[part]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), image_id.as_py())), pa.array(xs[part]), pa.array(ys[part]), pa.array(v), pa.array(component[part])], names)

    return run


def labelled_pixels(pictures: DataFrame, offset: float = 3.0) -> DataFrame:
    """image_id, x, y, v, component of the bright pixels. ``pictures``: image_id, width, bits, data, as
    ``sources.fits.decode_pixels`` reads them. Each picture is decoded once."""
    rows = pictures.filter("data is not null").select("image_id", F.col("width").cast("long").alias("width"), F.col("bits").cast("int").alias("bits"), "data")
    return rows.mapInArrow(_bright(offset), "image_id long, x long, y long, v long, component long")


def detect_in_pictures(pictures: DataFrame, offset: float = 3.0, shape: Callable[[Column, Column], Column] = star_shape) -> DataFrame:
    """The stars of pictures (image_id, width, height, bits, data), as ``detect_stars`` finds them in their pixels."""
    sizes = pictures.select("image_id", F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    return as_stars(filter_stars(measure_components(labelled_pixels(pictures, offset)), sizes, shape))


def detect_stars(pixels: DataFrame, sizes: DataFrame, offset: float = 3.0, shape: Callable[[Column, Column], Column] = star_shape) -> DataFrame:
    """image_id, star_id, x, y, brightness, size of the stars in each picture."""
    bright = stash(bright_pixels(pixels, background(histogram(pixels), offset)), "bright")
    return as_stars(filter_stars(measure_components(component_pixels(bright)), sizes, shape))
