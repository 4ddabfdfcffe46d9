"""Known answers, round trips and edge cases of the engine."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquad.fixtures import CENTER, fixture, pictures
from skyquad.functions import angles, plate, ratios, sphere
from skyquad.operators import bandjoin, cells, detect, fit, index, lookup, match, quads
from skyquad.plans import runs, search, solve
from skyquad.sinks import files, results, wcs
from skyquad.sources import bench_log, catalog, fits, raster, reader_for, register_reader
from skyquad.streaming import jobs


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(("radius", "ra", "dec", "cell", "meets"), [(8.0, 355.0, -25.0, "b10c00", True), (15.0, 250.0, 20.0, "b08c25", True), (10.0, 50.0, 30.0, "b02c01", False), (8.0, 0.0, 0.0, "b09c35", True), (15.0, 125.0, 80.0, "b01c04", True)])
def test_circle_meets_cell(spark, radius, ra, dec, cell, meets):
    row = cells.sky_cells(spark).filter(F.col("cell_id") == cell)
    assert row.select(cells.circle_meets_cell(F.lit(radius), F.lit(ra), F.lit(dec))).first()[0] is meets


def test_cells_cover_the_sky_once(spark):
    table = cells.sky_cells(spark)
    assert table.count() == 406
    points = spark.range(5000).select((F.rand(1) * 360).alias("ra"), (F.rand(2) * 180 - 90).alias("dec"))
    points = points.unionByName(spark.createDataFrame([(0.0, -90.0), (360.0, 90.0), (359.999, 0.0), (720.0, 10.0)], "ra double, dec double"))
    placed = cells.assign_cells(points).join(table.drop("band", "cell"), "cell_id")
    assert placed.count() == points.count()
    inside = (F.pmod("ra", F.lit(360.0)) >= F.col("ra_left")) & (F.pmod("ra", F.lit(360.0)) <= F.col("ra_right")) & F.col("dec").between(F.col("dec_bottom"), F.col("dec_top"))
    assert placed.filter(~inside).count() == 0


def test_blind_queue_sizes(spark):
    found = runs.blind_runs(spark, runs.BlindOptions(8.0, 0.5)).groupBy("radius").count().orderBy(F.desc("radius")).collect()
    assert [r["count"] for r in found] == [424, 1484, 5520, 21340, 83948]
    assert runs.ladder_sizes(runs.BlindOptions(20.0, 5.0)) == 100 + 280 + 972
    assert runs.ladder_sizes(runs.BlindOptions()) == 57_644


def test_radius_ladders():
    assert runs.radius_ladder(4.0) == [4.0] and runs.radius_ladder(2.0, 2.0, None) == [2.0]
    assert runs.radius_ladder(4.0, 1.0, 0) == [4.0, 1.0] and runs.radius_ladder(4.0, 1.0, None) == [4.0, 2.0, 1.0, 1.0]
    assert runs.radius_ladder(4.0, 1.0, 1) == [4.0, 2.5, 1.0, 1.0]


@pytest.mark.parametrize("bad", [lambda: runs.BlindOptions(0.0), lambda: runs.BlindOptions(31.0), lambda: runs.NearbyOptions(0, 91), lambda: solve.SolveOptions(sampling=0), lambda: solve.SolveOptions(lower_offset=-1), lambda: solve.SolveOptions(max_stars=3)])
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        bad()


def test_sexagesimal_texts(spark):
    row = one(spark, a=angles.ra_text_to_degrees(F.lit("00 42 47.12")), b=angles.dec_text_to_degrees(F.lit("-00 06 13.5")), c=angles.dec_text_to_degrees(F.lit("41 16 8")), d=angles.ra_text_to_degrees(F.lit("x 1 2")), e=angles.ra_text(F.lit(10.5)), f=angles.dec_text(F.lit(-0.5)))
    assert row.a == pytest.approx(10.696333, abs=1e-6) and row.b == pytest.approx(-0.10375) and row.c == pytest.approx(41.268889, abs=1e-6)
    assert row.d is None and row.e == "0 42 0" and row.f == "-0 30 0"


def test_equal_positions_are_zero_apart(spark):
    row = one(spark, d=sphere.angular_distance(F.lit(12.3), F.lit(45.6), F.lit(12.3), F.lit(45.6)), e=sphere.angular_distance(F.lit(0.0), F.lit(90.0), F.lit(123.0), F.lit(90.0)))
    assert row.d == 0 and row.e < 1e-6


def test_plane_round_trip(spark):
    points = spark.range(200).select((F.rand(3) * 20 + 350).alias("ra"), (F.rand(4) * 20 + 50).alias("dec"))
    x, y = sphere.to_plane("ra", "dec", F.lit(0.0), F.lit(60.0))
    back = points.withColumns({"x": -x, "y": -y})
    ra, dec = sphere.from_plane(F.lit(0.0), F.lit(60.0), "x", "y")
    worst = back.select(F.max(sphere.angular_distance(ra, dec, "ra", "dec"))).first()[0]
    assert worst < 1e-5


def test_packed_ratios(spark):
    rows = spark.range(500).select(*[F.rand(i).cast("float").alias(f"r{i}") for i in range(5)])
    names = [F.col(f"r{i}") for i in range(5)]
    back = rows.select(*names, *[u.alias(f"u{i}") for i, u in enumerate(ratios.unpack(ratios.pack(names)))], *[q.alias(f"q{i}") for i, q in enumerate(ratios.quantized(names))])
    for r in back.collect():
        for i, top in enumerate((1023, 1023, 1023, 511, 511)):
            assert abs(r[f"u{i}"] - r[f"r{i}"]) <= 0.5 / top + 1e-6 and r[f"u{i}"] == r[f"q{i}"]


def test_nearest_three_by_brute_force():
    rng = np.random.default_rng(0)
    points = rng.integers(0, 12, size=(700, 2)).astype(float)  # many ties and equal points
    found = {int(r[0]): r[1:].tolist() for r in quads.nearest_three(points, quads._plane)}
    for i, p in enumerate(points):
        apart = sorted((math.dist(p, q), j) for j, q in enumerate(points) if math.dist(p, q) > 0)
        assert found[i] == [j for _, j in apart[:3]]
    assert len(quads.nearest_three(points[:3], quads._plane)) == 0
    assert len(quads.nearest_three(np.zeros((9, 2)), quads._sphere)) == 0


def test_band_join_keeps_every_pair_of_a_nested_loop(spark):
    def some(n, seed, image):
        base = [F.rand(seed + i).alias(f"r{i}") for i in range(5)]
        rows = spark.range(n).select("id", *base).select("id", *[(F.round(F.col(f"r{i}") * 5) / 40 + F.rand(seed + 9 + i) / 500 + 0.2).cast("float").alias(f"r{i}") for i in range(5)])
        kept = rows.withColumn("largest", F.lit(1.0).cast("float"))
        return kept.select(F.lit(1).cast("long").alias("image_id"), F.col("id").alias("quad_id"), *[f"r{i}" for i in range(5)], "largest", F.lit(0.0).alias("mid_x"), F.lit(0.0).alias("mid_y")) if image else kept.withColumnRenamed("id", "pos")

    image, stored = some(400, 10, True).cache(), some(1500, 50, False).cache()
    got = {(r.quad_id, r.pos) for r in bandjoin.candidates(image, stored).filter("is_within").collect()}
    a = np.array([[r[f"r{i}"] for i in range(5)] for r in image.collect()], dtype=np.float32)
    b = np.array([[r[f"r{i}"] for i in range(5)] for r in stored.collect()], dtype=np.float32)
    low, high = (np.float32(v) for v in ratios.window())
    hit = ((a[:, None] >= b[None] * low) & (a[:, None] <= b[None] * high)).all(axis=2)
    ids, pos = [r.quad_id for r in image.collect()], [r.pos for r in stored.collect()]
    assert got == {(ids[i], pos[j]) for i, j in zip(*np.nonzero(hit), strict=True)} and len(got) > 20
    plan = bandjoin.candidates(image, stored)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_slices_are_disjoint_and_complete(spark):
    rows = spark.createDataFrame([(p, n) for n in (0, 1, 3, 4, 10, 17) for p in range(n)], "pos long, n_quads long")
    for k in (1, 2, 4, 7):
        parts = [rows.filter(lookup.in_slice("pos", "n_quads", k, s)) for s in range(k)]
        every = [tuple(r) for p in parts for r in p.collect()]
        assert sorted(every) == sorted(map(tuple, rows.collect())) and len(every) == len(set(every))


def test_greedy_matching_takes_each_catalog_quad_once_per_batch(spark):
    # Quads 0 and 1 share a batch, so both may take catalog quad 0; quad 5 may not any more.
    rows = [(1, 1, q, 0, "c", 0, 0, p, 9, True, 2.0, 1.0, 0.0, 0.0, 0.0, 0.0) for q, ps in ((0, (0, 1)), (1, (0,)), (5, (0, 1)), (6, (0,))) for p in ps]
    schema = "image_id long, run_id long, quad_id long, offset_pos int, cell_id string, pass int, subcell int, pos long, n_potential long, is_match boolean, i_largest float, largest float, i_x double, i_y double, mid_ra float, mid_dec float"
    found = match.one_to_one(spark.createDataFrame(rows, schema))
    assert sorted((r.quad_id, r.pos) for r in found.collect()) == [(0, 0), (1, 0), (5, 1)]
    assert match.one_to_one(spark.createDataFrame(rows, schema).withColumn("n_potential", F.lit(4))).count() == 0


def test_leave_one_out_is_a_refit_without_the_match(spark):
    rng = np.random.default_rng(2)
    x, y = rng.uniform(0, 1600, 30), rng.uniform(0, 1200, 30)
    u, v = 1e-4 * x + 3e-6 * y - 0.08 + rng.normal(0, 1e-6, 30), -1e-4 * y + 2e-6 * x + 0.06 + rng.normal(0, 1e-6, 30)
    rows = [(1, 1, i, *map(float, r), 174.0) for i, r in enumerate(zip(x, y, u, v, strict=True))]
    table = spark.createDataFrame(rows, "image_id long, run_id long, quad_id long, x double, y double, u double, v double, scale_ratio double")
    for r in fit.influence(table).collect():
        keep = np.arange(30) != r.quad_id
        design = np.stack([x, y, np.ones(30)], axis=1)
        change = [np.linalg.lstsq(design[k], -w[k], rcond=None)[0] for w in (u, v) for k in (keep, slice(None))]
        assert np.allclose([r.d_a, r.d_b, r.d_c, r.d_d, r.d_e, r.d_f], np.concatenate([change[0] - change[1], change[2] - change[3]]), rtol=1e-4, atol=1e-12)


def test_points_on_a_line_give_no_plate(spark):
    rows = [(1, 1, i, float(i), 2.0 * i, 1.0 * i, 1.0 * i, 0.0, 0.0, 1.0) for i in range(9)]
    table = spark.createDataFrame(rows, "image_id long, run_id long, quad_id long, x double, y double, u double, v double, ra0 double, dec0 double, scale_ratio double")
    assert fit.fit_plates(table).first().a is None


def test_solve_finds_the_planted_plate(spark):
    from skyquad.queries.solver import nearby_solution

    row = nearby_solution(spark, "/root/testdata/sf0.001").first()
    assert abs(row.ra - CENTER[0]) < 1e-2 and abs(row.dec - CENTER[1]) < 1e-2
    assert row.parity == "flipped" and row.pix_scale == pytest.approx(20.6265, rel=5e-3) and row.n_matches >= 8


def test_solve_without_stars_or_index_gives_no_rows(spark):
    sf = "/root/testdata/sf0.001"
    stars, catalog_stars = fixture(spark, sf, "image_stars"), fixture(spark, sf, "sky_stars")
    plan = runs.point_runs(spark, 18.0, 0.5, 5.7)
    options = index.IndexOptions(1.2, last_pass=0)
    built = index.build_index(catalog_stars, options)
    assert solve.solve_first(stars.limit(0), pictures(spark), built, plan).count() == 0
    assert solve.solve_first(stars, pictures(spark), index.build_index(catalog_stars.limit(0), options), plan).count() == 0
    assert search.solve_staged(stars, pictures(spark), built, plan, cancelled=lambda: True) is None


def test_components_touch_at_corners(spark):
    art = ["#..#.#", ".##..#", "......", "#.#...", ".#...#"]
    rows = [(1, x, y, 9) for y, line in enumerate(art) for x, c in enumerate(line) if c == "#"]
    found = detect.component_pixels(spark.createDataFrame(rows, "image_id long, x long, y long, v long"))
    groups = {}
    for r in found.collect():
        groups.setdefault(r.component, set()).add((r.x, r.y))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, [{(0, 0), (1, 1), (2, 1), (3, 0)}, {(5, 0), (5, 1)}, {(0, 3), (1, 4), (2, 3)}, {(5, 4)}]))


def test_detects_drawn_stars(spark):
    rng = np.random.default_rng(1)
    sky = rng.normal(1000, 5, (200, 300))
    spots = [(40, 50, 3), (120, 30, 2), (250, 150, 4), (80, 160, 3), (200, 90, 2)]
    yy, xx = np.mgrid[:200, :300]
    for x, y, r in spots:
        sky += 5000 * ((xx - x) ** 2 + (yy - y) ** 2 <= r * r)
    rows = [(1, 300, 16, (sky - 32768).astype(">i2").tobytes())]
    pixels = fits.decode_pixels(spark.createDataFrame([(i, w, b, bytearray(d)) for i, w, b, d in rows], "image_id long, width long, bits int, data binary"))
    sizes = spark.createDataFrame([(1, 3000, 2000)], "image_id long, image_width long, image_height long")
    found = detect.detect_stars(pixels, sizes)
    assert sorted((round(r.x), round(r.y)) for r in found.collect()) == sorted((x, y) for x, y, _ in spots)
    blank = detect.detect_stars(pixels.withColumn("v", F.lit(0).cast("long")), sizes)
    assert blank.count() == 0


def fits_bytes(cards, data=b""):
    text = "".join(c.ljust(80) for c in [*cards, "END"])
    head = text.ljust(-(-len(text) // 2880) * 2880).encode()
    return head + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def test_fits_pictures(spark, tmp_path):
    data = np.arange(12, dtype=">i2").tobytes()
    cards = ["SIMPLE  =                    T / standard", "BITPIX  =                   16", "NAXIS   =                    2", "NAXIS1  =                    4", "NAXIS2  =                    3", "OBJCTRA = '13 29 46.26'        / hours", "OBJCTDEC= '-00 10 58.94'", "COMMENT any / text"]
    (tmp_path / "a.fits").write_bytes(fits_bytes(cards + [f"KEY{i:<5}= {i}" for i in range(40)], data))
    (tmp_path / "b.fits").write_bytes(b"not a picture" * 400)
    (tmp_path / "c.fits").write_bytes(b"")
    found = reader_for("x/A.FITS")(spark, str(tmp_path)).collect()
    assert len(found) == 1 and (found[0].width, found[0].height, found[0].bits, found[0].offset) == (4, 3, 16, 5760)
    assert found[0].headers["OBJCTRA"] == "'13 29 46.26'" and found[0].headers["KEY7"] == "7" and found[0].view is None
    assert found[0].center.ra == pytest.approx(202.44275) and found[0].center.dec == pytest.approx(-0.183039, abs=1e-6)
    pixels = fits.decode_pixels(fits.read_fits(spark, str(tmp_path)).withColumn("image_id", F.lit(1).cast("long")))
    assert [r.v for r in pixels.orderBy("y", "x").collect()] == [32768 + i for i in range(12)]
    with pytest.raises(ValueError):
        reader_for("a.xyz")
    with pytest.raises(ValueError):
        register_reader(fits.read_fits, "FIT")


def test_star_lists(spark, tmp_path):
    table = np.array([[1, 2, 3.5], [4, 5, 12.25]], dtype=">f4")
    first = fits_bytes(["SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0", "EXTEND  =                    T"])
    second = ["XTENSION= 'BINTABLE'", "BITPIX  =                    8", "NAXIS   =                    2", "NAXIS1  =                   12", "NAXIS2  =                    2", "TFIELDS =                    3", "TFORM1  = 'E       '", "TFORM2  = 'E       '", "TFORM3  = '1E      '"]
    (tmp_path / "stars.xyls").write_bytes(first + fits_bytes(second, table.tobytes()))
    (tmp_path / "other.xyls").write_bytes(first + fits_bytes([*second[:5], "TFIELDS =                    2"], table.tobytes()))
    found = fits.read_star_lists(spark, str(tmp_path)).orderBy("star_id").collect()
    assert [(r.x, r.y, r.brightness, r.size) for r in found] == [(1.0, 2.0, 965_000, 1.0), (4.0, 5.0, 877_500, 1.0)]


def png(pixels, color, bits):
    height, width = pixels.shape[:2]
    rows = pixels.astype(">u2" if bits == 16 else np.uint8).reshape(height, -1).view(np.uint8)
    step = rows.shape[1] // width
    raw, above = b"", np.zeros(rows.shape[1] + step, dtype=np.int64)
    for y, row in enumerate(rows.astype(np.int64)):  # a different filter for each row
        kind, padded = y % 5, np.concatenate([np.zeros(step, dtype=np.int64), row])
        left, up, corner = padded[:-step], above[step:], above[:-step]
        guess = left + up - corner
        near = np.stack([abs(guess - left), abs(guess - up), abs(guess - corner)])
        paeth = np.choose(near.argmin(axis=0), [left, up, corner])
        raw += bytes([kind]) + ((row - [0, left, up, (left + up) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
        above = padded
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("bits", "channels"), [(8, 1), (16, 1), (8, 3), (16, 3), (8, 4)])
def test_png_pictures(spark, tmp_path, bits, channels):
    rng = np.random.default_rng(bits + channels)
    pixels = rng.integers(0, 1 << bits, size=(12, 7, channels))
    (tmp_path / "p.png").write_bytes(png(pixels, {1: 0, 3: 2, 4: 6}[channels], bits))
    found = raster.read_png(spark, str(tmp_path)).withColumn("image_id", F.lit(1).cast("long"))
    got = np.array([r.v for r in fits.decode_pixels(found).orderBy("y", "x").collect()]).reshape(12, 7)
    want = pixels[..., 0] if channels < 3 else np.rint(pixels[..., :3] @ np.array(raster.LUMA))
    assert (got == want).all()


def test_binary_star_records(spark, tmp_path):
    record = np.array([(1.5, -2.5, 7.25), (359.0, 89.0, 16.5)], dtype=[("ra", "<f8"), ("dec", "<f8"), ("mag", "<f4")])
    (tmp_path / "a.stars").write_bytes(record.tobytes())
    (tmp_path / "b.stars").write_bytes(b"")
    assert sorted(map(tuple, catalog.read_star_records(spark, str(tmp_path)).collect())) == [(1.5, -2.5, 7.25), (359.0, 89.0, 16.5)]


def test_wcs_numbers_and_files(spark):
    for value in (3.4703595730434245e-07, -1.0, 0.0, 180.0, 1e13, 123456789012.5, -0.0001, 0.00001, 1 / 3):
        assert spark.range(1).select(wcs.number_text(F.lit(value))).first()[0] == f"{value:.13G}"
    record = one(spark, r=wcs.number_record("CD1_1", F.lit(3.4703595730434245e-07), "cd matrix")).r
    assert len(record) == 80 and record[10:30].endswith("E-07")
    assert len(one(spark, r=wcs.text_record("LONGNAME1", F.lit("x" * 100), "c")).r) == 80


def test_result_texts(spark):
    rows = [(1, 10.0, -5.0, "normal", 3, 7, True), (2, None, None, None, None, 9, False), (3, None, None, None, None, 4, None)]
    solved = spark.createDataFrame(rows, "image_id long, ra double, dec double, parity string, n_matches long, stars_detected long, success boolean")
    found = {r.image_id: r.json for r in results.as_json(solved, extended=True, pretty=False).collect()}
    assert found[1] == '{"success":true,"ra":10.0,"dec":-5.0,"ra_hms":"0 40 0","dec_dms":"-5 0 0","parity":"normal","starsDetected":7,"quadMatches":3}'
    assert found[2] == '{"success":false,"starsDetected":9}' and found[3] == '{"success":false,"starsDetected":4}'
    short = results.as_json(solved.drop("success"), pretty=False).collect()
    assert [r.json for r in short] == ['{"success":true,"ra":10.0,"dec":-5.0,"ra_hms":"0 40 0","dec_dms":"-5 0 0","parity":"normal"}', '{"success":false}', '{"success":false}']
    lines = results.as_tsv(solved).orderBy("image_id", "line").collect()
    assert [r.text for r in lines if r.image_id == 1] == ["success\ttrue", "ra\t10.0", "dec\t-5.0", "ra_hms\t0 40 0", "dec_dms\t-5 0 0", "parity\tnormal"]
    assert [(r.line, r.text) for r in lines if r.image_id == 2] == [(0, "success\tfalse")]


def test_a_file_for_each_picture_and_job(spark, tmp_path):
    columns = {"width": 1600, "height": 1200, "ra0": 18.0, "dec0": 0.5, "a": 1e-4, "b": 0.0, "c": -0.08, "d": 1e-9, "e": -1e-4, "f": 0.06, "pixels_per_degree": 174.5}
    solved = plate.add_wcs(spark.range(40).select(F.col("id").alias("image_id"), *[F.lit(v).alias(k) for k, v in columns.items()])).withColumn("crval1", F.col("image_id") * 1.5)
    files.write_wcs(solved, str(tmp_path / "wcs"))
    want = {r.image_id: bytes(r.content) for r in wcs.wcs_files(solved).collect()}
    found = {int(p.parent.name.split("=")[1]): p.read_bytes() for p in (tmp_path / "wcs").glob("image_id=*/part-*")}
    assert found == want and all(len(c) % 2880 == 0 for c in found.values()) and len(found) == 40
    files.write_wcs(solved.filter("image_id = 7").withColumn("crval1", F.lit(3e0)), str(tmp_path / "wcs"))  # only its own file is replaced
    again = {int(p.parent.name.split("=")[1]): p.read_bytes() for p in (tmp_path / "wcs").glob("image_id=*/part-*")}
    assert len(again) == 40 and {k for k in again if again[k] != want[k]} == {7}
    files.write_results(solved, str(tmp_path / "tsv"), form="tsv")
    assert next((tmp_path / "tsv" / "image_id=3").glob("part-*")).read_text().startswith("success\ttrue\nra\t")
    jobs_ = spark.createDataFrame([("a", "Queued", 1), ("b", "Queued", 2)], "job_id string, status string, n long")
    files.write_jobs(jobs_, str(tmp_path / "jobs"))
    files.write_jobs(jobs_.filter("job_id = 'a'").withColumn("status", F.lit("Solving")), str(tmp_path / "jobs"))
    read = lambda *only: sorted((r.job_id, r.status, r.n) for r in files.read_jobs(spark, str(tmp_path / "jobs"), "status string, n long", *only).collect())
    assert read() == [("a", "Solving", 1), ("b", "Queued", 2)] and read("b") == [("b", "Queued", 2)]


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    """One task of many breaks, after others have written theirs."""

    def breaks(batches):
        for batch in batches:
            if 13 in batch["n"].tolist():
                raise ValueError("planted")
            yield batch

    rows = spark.range(0, 40, 1, 8).select(F.col("id").cast("string").alias("job_id"), F.col("id").alias("n")).mapInPandas(breaks, "job_id string, n long")
    with pytest.raises(Exception, match="planted"):
        files.write_jobs(rows, str(tmp_path / "jobs"))
    assert not list(tmp_path.glob("jobs/job_id=*"))


def test_bench_output(spark):
    out = spark.createDataFrame([('{\n "success": true,\n "ra": 1.5\n}\nSOLVE_DURATION: 2.5\n',), ("no result",), (None,)], "output string")
    rows = bench_log.parse_output(out).collect()
    assert (rows[0].result.success, rows[0].result.ra, rows[0].solve, rows[0].image_read) == (True, 1.5, 2.5, None)
    assert rows[2].solve is None


def test_pixel_and_sky_agree_at_the_reference(spark):
    columns = {"width": 1600, "height": 1200, "ra0": 18.0, "dec0": 0.5, "a": 1e-4, "b": 0.0, "c": -0.08, "d": 1e-9, "e": -1e-4, "f": 0.06, "pixels_per_degree": 174.5}
    solved = plate.add_wcs(spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]))
    ra, dec = plate.pixel_to_sky(F.lit(1000), F.lit(500))
    x, y = plate.sky_to_pixel("_ra", "_dec", mirrored=False)
    row = solved.withColumns({"_ra": ra, "_dec": dec}).select(x.alias("x"), y.alias("y"), "parity").first()
    assert (row.x, row.y) == (1000, 500)


def test_job_stream(spark, tmp_path):
    schema = "job_id string, ts timestamp, event string"
    days = lambda rows: [(j, __import__("datetime").datetime(2024, 1, d), e) for j, d, e in rows]
    source, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    batches = [[("a", 1, "submit"), ("b", 1, "submit"), ("c", 1, "start")], [("a", 2, "start"), ("b", 2, "cancel"), ("a", 3, "succeed"), ("c", 4, "submit")], [("a", 5, "cancel"), ("b", 5, "start")]]
    for rows in batches:
        spark.createDataFrame(days(rows), schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        jobs.write_states(jobs.job_states(stream), str(out), str(check)).awaitTermination()
    found = {r.job_id: (r.status, r.updated.day, r.n_events) for r in jobs.latest_states(spark, str(out)).collect()}
    assert found == {"a": ("Success", 3, 4), "b": ("Canceled", 2, 3), "c": ("Queued", 4, 2)}


def test_short_ids(spark):
    assert one(spark, i=jobs.short_id(F.lit("00112233-4455-6677-8899-aabbccddeeff"))).i == __import__("re").sub("[/+=]", "", __import__("base64").b64encode(__import__("uuid").UUID("00112233-4455-6677-8899-aabbccddeeff").bytes_le).decode())
