"""Pictures decoded once and labelled where they are; row filters; files known by their content; readers of one's own."""

from __future__ import annotations

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_engine import fits_bytes

from skyquad.operators import detect
from skyquad.plans import pictures
from skyquad.sources import fits, raster, registry


def table_of(spark, images):
    """16-bit samples: image_id -> (height, width) whole numbers."""
    rows = [(i, a.shape[1], a.shape[0], 16, bytearray((a - 32768).astype(">i2").tobytes())) for i, a in images.items()]
    return spark.createDataFrame(rows, "image_id long, width long, height long, bits int, data binary")


def skies():
    rng = np.random.default_rng(5)
    out = {}
    for i, (height, width) in enumerate([(60, 80), (1, 50), (50, 1), (97, 33), (128, 128), (30, 30)]):
        sky = rng.integers(90, 110, size=(height, width))
        for _ in range(height * width // 60):
            y, x, size = rng.integers(height), rng.integers(width), rng.integers(1, 6)
            sky[y : y + size, x : x + rng.integers(1, 6)] += rng.integers(500, 9000)
        for k in range(0, min(height, width) - 2, 3):  # diagonals, which touch at corners
            sky[k, k], sky[k + 1, k + 1] = 20_000, 20_000
        out[i] = sky
    out[9] = np.zeros((8, 8), dtype=np.int64)  # mean 0: no stars
    out[10] = np.full((8, 8), 7, dtype=np.int64)
    return out


def test_both_ways_give_the_same_components_and_stars(spark):
    table = table_of(spark, skies())
    pixels = fits.decode_pixels(table)
    bright = detect.bright_pixels(pixels, detect.background(detect.histogram(pixels)))
    order = ["image_id", "y", "x"]
    want = [tuple(r) for r in detect.component_pixels(bright).select(*order, "v", "component").orderBy(*order).collect()]
    found = [tuple(r) for r in detect.labelled_pixels(table).select(*order, "v", "component").orderBy(*order).collect()]
    assert found == want and len({(r[0], r[4]) for r in found}) > 50
    sizes = table.select("image_id", F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    stars = lambda df: sorted(map(tuple, df.select("image_id", "star_id", "x", "y", "brightness", "size").collect()))
    assert stars(detect.detect_in_pictures(table)) == stars(detect.detect_stars(pixels, sizes))
    # One decode of a picture, and only its bright pixels leave the task.
    plan = detect.detect_in_pictures(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert detect.labelled_pixels(table).count() < 0.3 * sum(a.size for a in skies().values())


@pytest.mark.parametrize("seed", range(20))
def test_labels_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((rng.integers(1, 30), rng.integers(1, 30))) < rng.choice([0.2, 0.45, 0.7])
    runs = []
    for y, row in enumerate(mask):
        x = 0
        while x < len(row):
            if row[x]:
                end = x
                while end + 1 < len(row) and row[end + 1]:
                    end += 1
                runs.append((y, x, end))
                x = end
            x += 1
    root = list(range(len(runs)))
    changed = True
    while changed:
        changed = False
        for i, (y, a, b) in enumerate(runs):
            for j, (z, c, d) in enumerate(runs):
                if y == z + 1 and c <= b + 1 and d >= a - 1 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    y, left, right = (np.array([r[k] for r in runs], dtype=np.int64) for k in range(3))
    assert detect.label_runs(y, left, right).tolist() == root


def test_a_picture_of_16_megapixels(spark):
    rng = np.random.default_rng(3)
    sky = rng.integers(900, 1100, size=(4096, 4096))
    for y, x in rng.integers(5, 4090, size=(2000, 2)):
        sky[y : y + 3, x : x + 3] = 30_000
    began = time.process_time()
    values, n = (sky.reshape(-1)), 0
    flat = detect.threshold(values, 3.0)
    assert 1000 < flat < 30_000
    table = table_of(spark, {1: sky})
    n = detect.detect_in_pictures(table).count()
    assert 1800 < n <= 2000 and time.process_time() - began < 60


def filtered(rows, kinds, step):
    """The PNG filters, one byte after the other, as the format defines them."""
    out, above = b"", [0] * len(rows[0])
    for line, kind in zip(rows, kinds, strict=True):
        coded = []
        for x, v in enumerate(line):
            left, up, corner = line[x - step] if x >= step else 0, above[x], above[x - step] if x >= step else 0
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            coded.append((v - [0, left, up, (left + up) // 2, paeth][kind]) % 256)
        out += bytes([kind]) + bytes(coded)
        above = line
    return out


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("step", [1, 2, 3, 6, 8])
def test_row_filters_are_undone(seed, step):
    rng = random.Random(seed)
    height, stride = rng.randint(1, 9), rng.choice([step, step * 2, step * rng.randint(1, 12), rng.randint(1, 40)])
    rows = [[rng.randrange(256) for _ in range(stride)] for _ in range(height)]
    kinds = [rng.choice(range(5) if seed % 3 else [3, 4]) for _ in rows]
    assert raster._unfilter(filtered(rows, kinds, step), height, stride, step).tolist() == rows


def test_a_large_picture_of_the_slowest_filter():
    """16 million samples, each by the nearest of three neighbours."""
    raw = (bytes([4]) + bytes(4096)) * 4096
    began = time.process_time()
    assert not raster._unfilter(raw, 4096, 4096, 1).any()
    assert time.process_time() - began < 20
    with pytest.raises(ValueError):
        raster._unfilter(bytes([5, 0]), 1, 1, 1)


def jpeg(spark, width=24, height=16):
    """By the JVM's own writer."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(width, height, 10)
    image.getRaster().setSample(3, 4, 0, 250)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


GRAY = fits_bytes(["SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    2", "NAXIS1  =                    2", "NAXIS2  =                    2"], b"\1\2\3\4")


def test_jpeg_is_known_by_its_content(spark, tmp_path):
    content = jpeg(spark)
    for name in ("a.jpg", "b.JPEG", "c.dat", "d"):
        (tmp_path / name).write_bytes(content)
    (tmp_path / "e.jpg").write_bytes(GRAY)
    (tmp_path / "f.jpg").write_bytes(b"\xff\xd8\xff broken")
    found = {r.path.rsplit("/", 1)[1]: r for r in pictures.read_pictures(spark, str(tmp_path)).collect()}
    assert sorted(found) == ["a.jpg", "b.JPEG", "c.dat", "d", "e.jpg", "f.jpg"]
    for name in ("a.jpg", "b.JPEG", "c.dat", "d"):
        assert (found[name].width, found[name].height, found[name].bits, found[name].error) == (24, 16, 8, None) and len(found[name].data) == 24 * 16
    assert (found["e.jpg"].width, found["e.jpg"].error) == (2, None) and found["f.jpg"].error.startswith("JPEG")


def test_contents_at_hand(spark):
    table = ["XTENSION= 'BINTABLE'", "BITPIX  =                    8", "NAXIS   =                    2", "NAXIS1  =                   12", "NAXIS2  =                    2", "PCOUNT  = 0", "GCOUNT  = 1", "TFIELDS =                    3", "TFORM1  = 'E'", "TFORM2  = 'E'", "TFORM3  = 'E'"]
    head = fits_bytes(["SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0"], b"")[:2880]
    stars = head + fits_bytes(table, np.array([[1, 2, 10], [3, 4, 11]], dtype=">f4").tobytes())
    found = pictures.pictures_from_bytes(spark, {"photo": jpeg(spark), "sky": GRAY}).collect()
    assert sorted((r.path, r.width) for r in found) == [("photo", 24), ("sky", 2)]
    rows = pictures.star_lists_from_bytes(spark, {"list": stars}).orderBy("star_id").collect()
    assert [(r.x, r.y, r.brightness) for r in rows] == [(1.0, 2.0, 900_000), (3.0, 4.0, 890_000)]


def test_a_reader_of_ones_own(spark, tmp_path):
    """A format of text: width, height, samples."""

    def read(session, path):
        rows = session.read.format("binaryFile").option("pathGlobFilter", "*.sky").load(path)
        parts = F.split(F.decode("content", "UTF-8"), " ")
        numbers = F.transform(F.slice(parts, 3, 10_000), lambda s: F.lpad(F.hex(s.cast("int")), 2, "0"))
        return rows.select("path", parts[0].cast("long").alias("width"), parts[1].cast("long").alias("height"), F.lit(8).alias("bits"), F.unhex(F.array_join(numbers, "")).alias("data"))

    (tmp_path / "one.sky").write_text("3 2 1 2 3 4 5 250")
    (tmp_path / "two.fits").write_bytes(GRAY)
    registry.register_reader(read, "SKY")
    try:
        found = {r.path.rsplit("/", 1)[1]: r for r in pictures.read_pictures(spark, str(tmp_path)).collect()}
        assert sorted(found) == ["one.sky", "two.fits"] and bytes(found["one.sky"].data) == bytes([1, 2, 3, 4, 5, 250])
        pixels = fits.decode_pixels(pictures.read_pictures(spark, str(tmp_path)).filter("path like '%.sky'")).orderBy("y", "x").collect()
        assert [(p.x, p.y, p.v) for p in pixels] == [(0, 0, 1), (1, 0, 2), (2, 0, 3), (0, 1, 4), (1, 1, 5), (2, 1, 250)]
        assert registry.reader_for("x/y.Sky") is read
        seen = []
        detector = lambda p, s: (seen.append(1), p.filter("v > 200").select("image_id", F.lit(0).cast("long").alias("star_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("v").alias("brightness"), F.lit(1e0).alias("size")))[1]
        stars = pictures.picture_stars(pictures.read_pictures(spark, str(tmp_path)), detector).collect()
        assert seen and [(s.x, s.y, s.brightness) for s in stars] == [(2.0, 1.0, 250)]
    finally:
        registry.unregister_reader("sky")
    assert "sky" not in registry.own_readers() and zlib.crc32(b"") == 0
