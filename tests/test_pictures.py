"""Picture files to plates, readers that report, index builds that failed, and what is asked for."""

from __future__ import annotations

import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_engine import fits_bytes, png

from skyquad.fixtures import CENTER, fixture, fixture_index_options
from skyquad.operators import annotate, index
from skyquad.plans import pictures, runs, solve, validation
from skyquad.sinks import results
from skyquad.sources import fits, raster
from skyquad.streaming import jobs


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    stars = fixture(spark, SF, "sky_stars")
    return index.write_index(stars, f"file://{tmp_path_factory.mktemp('index')}", fixture_index_options(stars))


def drawn(spark, hint=True):
    """The planted picture as a FITS file: each star a square of three pixels, brighter ones brighter."""
    sky = np.random.default_rng(1).integers(90, 110, size=(1200, 1600))
    for s in fixture(spark, SF, "image_stars").collect():
        x, y = round(s.x), round(s.y)
        if 1 < x < 1598 and 1 < y < 1198:
            sky[y - 1 : y + 2, x - 1 : x + 2] = min(30_000, 3000 + s.brightness // 40)
    cards = ["SIMPLE  =                    T", "BITPIX  =                   16", "NAXIS   =                    2", "NAXIS1  =                 1600", "NAXIS2  =                 1200"]
    cards += ["RA      =                 17.9", "DEC     =                  0.6", "PIXSIZE1=                  3.8", "PIXSIZE2=                  3.8", "FOCALLEN=                37.92"] * hint
    return fits_bytes(cards, (sky - 32768).astype(">i2").tobytes())


def test_files_to_plates(spark, tmp_path, built):
    (tmp_path / "sky.fits").write_bytes(drawn(spark))
    (tmp_path / "plain.fit").write_bytes(drawn(spark, hint=False))
    (tmp_path / "dark.png").write_bytes(png(np.zeros((20, 30, 1), dtype=np.int64), 0, 8))
    (tmp_path / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    (tmp_path / "notes.txt").write_bytes(b"no picture")
    plan = runs.point_runs(spark, 18.05, 0.45, 5.73)
    found = {r.path.rsplit("/", 1)[1]: r for r in pictures.solve_files(spark, str(tmp_path), built, search_radius=2.0, fallback=plan).collect()}
    assert {n: r.status for n, r in found.items()} == {"sky.fits": "Success", "plain.fit": "Success", "dark.png": "Failure", "broken.png": "Error"}
    for name in ("sky.fits", "plain.fit"):
        assert abs(found[name].ra - CENTER[0]) < 0.02 and abs(found[name].dec - CENTER[1]) < 0.02 and found[name].n_stars > 20
    assert found["broken.png"].error.startswith("PNG")


def test_pictures_as_they_arrive(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"in{i}.png").write_bytes(png(np.full((4, 4, 1), i, dtype=np.int64), 0, 8))
    out = f"{tmp_path}/out"
    query = jobs.solve_arrivals(spark, f"{tmp_path}/*.png", lambda p: p.select("path", "width", "error"), out, f"{tmp_path}/checkpoint", at_once=2)
    query.awaitTermination()
    found = spark.read.option("basePath", out).parquet(out).collect()
    assert sorted(r.path[-7:] for r in found) == ["in0.png", "in1.png", "in2.png"] and len({r.batch for r in found}) == 2


def test_nearby_search_reads_only_its_area(spark, built):
    stars, plan = fixture(spark, SF, "image_stars"), runs.point_runs(spark, 18.0, 0.5, 5.7)
    search = solve.open_search(stars, spark.createDataFrame([(1, 1600, 1200)], "image_id long, width long, height long"), built, runs=plan)
    scan = search.index.quads._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in scan and "cell_id" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert 0 < search.index.quads.count() < built.quads.count()
    # Many pictures and many runs meet through cells, not in a product.
    asked = solve.runs_of_pictures(search, runs.blind_runs(spark, runs.BlindOptions(5.0, 5.0)))
    text = asked._jdf.queryExecution().toString()
    assert "Cartesian" not in text and text.split("== Physical Plan ==")[1].count("NestedLoop") == 1  # runs and the 406 cells
    assert 0 < asked.count() < 1000


def test_builds_that_failed_are_resumed_once(spark, tmp_path):
    stars = fixture(spark, SF, "sky_stars")
    folder, options = f"file://{tmp_path}/index", fixture_index_options(stars)
    first = index.write_index(stars, folder, options)
    counts = lambda i: (i.quads.count(), i.passes.count(), i.subcells.count(), i.passes.agg(F.max("density_rank")).first()[0])
    want = counts(first)
    for p in sorted((tmp_path / "index" / "cells").rglob("*"), reverse=True):  # as if it had failed before the last table
        p.rmdir() if p.is_dir() else p.unlink()
    (tmp_path / "index" / "cells").rmdir()
    assert counts(index.write_index(stars, folder, options)) == want
    assert counts(index.write_index(stars, folder, options)) == want
    other = index.IndexOptions(options.stars_per_square_degree, last_pass=0)
    with pytest.raises(ValueError, match="other options"):
        index.write_index(stars, folder, other)
    anew = index.write_index(stars, folder, other, resume=False)
    assert {r["pass"] for r in anew.quads.select("pass").distinct().collect()} == {0}
    none = index.write_index(stars.limit(0), f"file://{tmp_path}/none", options)
    assert counts(none)[:3] == (0, 0, 0)
    with pytest.raises(ValueError):
        index.read_index(spark, f"file://{tmp_path}/nowhere")


def chunked_png(width, height, bits, color, raw, interlaced=0, palette=b""):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, color, 0, 0, interlaced))
    return b"\x89PNG\r\n\x1a\n" + head + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_kinds(spark):
    rng = np.random.default_rng(3)
    for bits in (1, 2, 4):
        pixels = rng.integers(0, 1 << bits, size=(5, 11))
        padded = np.zeros((5, -(-11 * bits // 8) * 8 // bits), dtype=np.int64)
        padded[:, :11] = pixels
        packed = np.packbits(((padded[..., None] >> np.arange(bits)[::-1]) & 1).reshape(5, -1).astype(np.uint8), axis=1)
        raw = b"".join(b"\0" + r.tobytes() for r in packed)
        width, height, depth, data = raster.decode_png(chunked_png(11, 5, bits, 0, raw))
        assert (width, height, depth) == (11, 5, 8)
        assert (np.frombuffer(data, np.uint8).reshape(5, 11) == pixels * 255 // ((1 << bits) - 1)).all()
        palette = rng.integers(0, 256, size=(1 << bits, 3))
        data = raster.decode_png(chunked_png(11, 5, bits, 3, raw, palette=palette.astype(np.uint8).tobytes()))[3]
        assert (np.frombuffer(data, np.uint8).reshape(5, 11) == np.rint(palette[pixels] @ np.array(raster.LUMA))).all()
    pixels = rng.integers(0, 256, size=(13, 9))
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for x, y, dx, dy in raster._PASSES for row in pixels[y::dy, x::dx] if row.size)
    assert (np.frombuffer(raster.decode_png(chunked_png(9, 13, 8, 0, raw, interlaced=1))[3], np.uint8).reshape(13, 9) == pixels).all()
    for bad in (b"\x89PNG\r\n\x1a\n", chunked_png(3, 3, 8, 7, b""), chunked_png(3, 3, 8, 0, b"\0")):
        with pytest.raises(ValueError):
            raster.decode_png(bad)


def test_jpeg_pictures(spark, tmp_path):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(16, 8, jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY)
    for x in range(16):
        for y in range(8):
            image.getRaster().setSample(x, y, 0, 200 if x >= 8 else 50)
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(f"{tmp_path}/a.jpg"))
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xffnot really")
    found = {r.path[-5:]: r for r in raster.read_jpeg(spark, str(tmp_path)).collect()}
    assert (found["a.jpg"].width, found["a.jpg"].height, found["a.jpg"].error) == (16, 8, None) and found["b.jpg"].error
    gray = np.frombuffer(found["a.jpg"].data, np.uint8).reshape(8, 16)
    assert abs(gray[:, :8].astype(int) - 50).max() < 8 and abs(gray[:, 8:].astype(int) - 200).max() < 8


def test_long_headers_and_odd_fits_files(spark, tmp_path):
    cards = ["SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    2", "NAXIS1  =                    2", "NAXIS2  =                    2"]
    (tmp_path / "long.fits").write_bytes(fits_bytes(cards + [f"KEY{i:<5}= {i}" for i in range(4000)], b"\1\2\3\4"))
    (tmp_path / "cube.fits").write_bytes(fits_bytes([cards[0], cards[1], cards[2].replace("2", "3"), *cards[3:]], b"\1\2\3\4"))
    (tmp_path / "endless.fits").write_bytes("".join(c.ljust(80) for c in cards).ljust(2880 * 3).encode())
    (tmp_path / "short.fits").write_bytes(fits_bytes([*cards[:3], "NAXIS1  =                 9000", cards[4]], b"\1"))
    found = {r.path.rsplit("/", 1)[1]: r for r in fits.read_fits(spark, str(tmp_path)).collect()}
    assert bytes(found["long.fits"].data) == b"\1\2\3\4" and found["long.fits"].headers["KEY3999"] == "3999" and found["long.fits"].error is None
    assert {n: r.error for n, r in found.items() if r.error} == {"cube.fits": "FITS: not two-dimensional", "endless.fits": "FITS: no END record", "short.fits": "FITS: pixels are missing"}


def test_what_is_asked_for(spark):
    schema = "file_name string, n_bytes long, mode string, use_fits_headers boolean, ra double, dec double, search_radius double, min_radius double, max_radius double, lower_offset int, higher_offset int"
    rows = [
        ("a.FITS", 10, "nearby", True, None, None, 10.0, None, None, 1, 1), ("a.gif", 0, "nearby", False, 1.0, None, 70.0, 0.05, 20.0, 4, 5),
        (None, None, "other", None, None, None, None, None, None, None, None), ("b.jpeg", 5, "blind", None, None, None, None, None, 17.0, 0, 0),
    ]
    found = [[p.field for p in r.problems] for r in validation.with_problems(spark.createDataFrame(rows, schema)).collect()]
    assert found[0] == [] and found[1] == ["image", "image", "search_radius", "use_fits_headers", "max_radius", "min_radius", "higher_offset", "lower_offset"]
    assert found[2] == ["image", "image", "mode"] and found[3] == ["max_radius", "min_radius"]
    assert validation.beyond_limits(solve.SolveOptions()) == []
    assert len(validation.beyond_limits(solve.SolveOptions(max_stars=5000, higher_offset=4), runs.NearbyOptions(1.0, 2.0, 20.0, 0.05, 80.0))) == 5
    assert len(validation.beyond_limits(solve.SolveOptions(), runs.BlindOptions(20.0, 5.0))) == 1


def test_reports_and_poles(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1.5, True), (2, 2.5, False)], "config_id long, duration_solve double, solved boolean")
    results.write_report(rows, f"{tmp_path}/report")
    lines = [line for p in sorted((tmp_path / "report").glob("*.csv")) for line in p.read_text().splitlines()]
    assert lines[0].split("|")[:2] == ["config_id", "duration_solve"] and len([x for x in lines if x[0].isdigit()]) == 2
    assert jobs.purge(spark.createDataFrame([("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 9))], "job_id string, updated timestamp"), F.lit(datetime(2024, 1, 10))).count() == 1


def test_visible_poles(spark):
    from skyquad.functions.plate import add_wcs

    def plate(dec0):
        table = spark.createDataFrame([(1, 1, 0.0, dec0, 1e-4, 0.0, -0.05, 0.0, 1e-4, -0.05, 9, 1000, 1000, 174.5)], "image_id long, run_id long, ra0 double, dec0 double, a double, b double, c double, d double, e double, f double, n_matches long, width long, height long, pixels_per_degree double")
        return add_wcs(table).select(annotate.pole_visible().alias("p")).first().p

    assert plate(89.5) is True and plate(10.0) is False


def test_pictures_at_hand_and_data_sets(spark, tmp_path):
    content = png(np.full((4, 5, 1), 7, dtype=np.int64), 0, 8)
    found = pictures.pictures_from_bytes(spark, {"stdin": content, "other": b"x", "sky": fits_bytes(["SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    2", "NAXIS1  =                    2", "NAXIS2  =                    2"], b"\1\2\3\4")}).collect()
    assert {(r.path, r.width, r.height, bytes(r.data)) for r in found} == {("stdin", 5, 4, b"\7" * 20), ("sky", 2, 2, b"\1\2\3\4")}
    for name in ("a.png", "b.png", "c.txt"):
        (tmp_path / name).write_bytes(content)
    assert sorted(r.path[-5:] for r in pictures.dataset_files(spark, str(tmp_path), "*.png").collect()) == ["a.png", "b.png"]
