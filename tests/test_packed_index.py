"""Packed index files, written here byte by byte."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from skyquad.functions.ratios import BITS
from skyquad.sources.packed_index import descriptors, read_packed_index, records


def packed(ratios, floats, order):
    value, shift = 0, 0
    for r, bits in zip(ratios, BITS):
        value |= round(r * ((1 << bits) - 1)) << shift
        shift += bits
    return value.to_bytes(6, "little") + struct.pack(order + "fff", *floats)


def write_index(folder, name, cells, order):
    """``cells``: (file, band, cell, [(density, divisions, [(ra, dec, [(ratios, floats)])])])."""
    head = b"SOMETHINGINDEX" + bytes([1, order == "<"])
    for file, band, cell, passes in cells:
        head += bytes([len(file)]) + file.encode() + struct.pack(order + "iii", band, cell, len(passes))
        body = b"SOMETHING" + struct.pack(order + "i", 3)
        for density, divisions, subcells in passes:
            head += struct.pack(order + "fii", density, divisions, len(subcells))
            for ra, dec, quads in subcells:
                data = b"".join(packed(*q, order) for q in quads)
                head += struct.pack(order + "ffi", ra, dec, len(data))
                body += data
        (folder / file).write_bytes(body)
    (folder / name).write_bytes(head)


@pytest.mark.parametrize("order", ["<", ">"])
def test_packed_files_are_an_index(spark, tmp_path, order):
    rng = np.random.default_rng(2)
    quad = lambda: (rng.random(5), rng.random(3) * 90)
    first = [("a.qdb", 9, 1, [(2.5, 2, [(10.0 + i % 2, -1.0 + i // 2, [quad() for _ in range(i)]) for i in range(4)]), (5.0, 2, [(10.0 + i % 2, -1.0 + i // 2, [quad()]) for i in range(4)])])]
    second = [("b.qdb", 9, 1, [(1.5, 2, [(10.0 + i % 2, -1.0 + i // 2, [quad()]) for i in range(4)])]), ("c.qdb", 3, 12, [(4.0, 2, [(50.0, 40.0, []), (51.0, 40.0, [quad()]), (50.0, 41.0, []), (51.0, 41.0, [])])])]
    write_index(tmp_path, "one.qdbindex", first, order)
    write_index(tmp_path, "two.qdbindex", second, order)
    found = read_packed_index(spark, f"file://{tmp_path}")
    ladder = sorted((r.cell_id, r.density_rank, r["pass"], r.n_quads, r.density) for r in found.passes.collect())
    assert ladder == [("b03c12", 1, 1000, 1, 4.0), ("b09c01", 1, 1000, 4, 1.5), ("b09c01", 2, 0, 6, 2.5), ("b09c01", 3, 1, 4, 5.0)]
    got = {(r.cell_id, r["pass"], r.subcell, r.pos): r for r in found.quads.collect()}
    number = {("a.qdb", 0): 0, ("a.qdb", 1): 1, ("b.qdb", 0): 1000, ("c.qdb", 0): 1000}
    want = {(f"b{band:02d}c{cell:02d}", number[file, p], s, i): q for file, band, cell, passes in first + second for p, (_, _, subs) in enumerate(passes) for s, (_, _, quads) in enumerate(subs) for i, q in enumerate(quads)}
    assert {k for k in got if k[0] == "b09c01"} == {k for k in want if k[0] == "b09c01"} and len(got) == len(want)
    for key, (ratios, floats) in want.items():
        r = got[key]
        assert np.allclose([r.r0, r.r1, r.r2, r.r3, r.r4], ratios, atol=1e-3) and np.allclose([r.largest, r.mid_ra, r.mid_dec], floats, rtol=1e-6)
    assert found.subcells.filter("cell_id = 'b09c01'").count() == 12 and all(r.avg_subcell_radius > 0 for r in found.passes.collect())


@pytest.mark.parametrize("order", ["<", ">"])
def test_only_the_ranges_of_a_search_are_read(spark, tmp_path, order):
    """The same rows as by whole files; of other cells and passes not a byte, even if it isn't there."""
    rng = np.random.default_rng(4)
    quad = lambda: (rng.random(5), rng.random(3) * 90)
    passes = lambda: [(2.5 * (p + 1), 2, [(10.0 + i % 2, -1.0 + i // 2, [quad() for _ in range(rng.integers(0, 40))]) for i in range(4)]) for p in range(3)]
    cells = [(f"c{c}.qdb", 9, c, passes()) for c in range(5)]
    write_index(tmp_path, "one.qdbindex", cells, order)
    write_index(tmp_path, "two.qdbindex", [("d.qdb", 9, 1, passes())], order)
    folder = f"file://{tmp_path}"
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(read_packed_index(spark, folder).quads)
    found = read_packed_index(spark, folder, by_ranges=True)
    assert rows(found.quads) == whole and len(whole) > 300
    asked = found.quads.filter("cell_id = 'b09c01' and pass in (1, 1000) and r0 > 0.3 and r0 < 0.6")
    want = [r for r in whole if r[0] == "b09c01" and r[1] in (1, 1000) and 0.3 < r[4] < 0.6]
    assert rows(asked) == want and want
    assert asked.rdd.getNumPartitions() == 2 and found.quads.rdd.getNumPartitions() == 18
    assert rows(found.quads.filter("cell_id in ('b09c02', 'b09c03') and pass >= 1 and pos < 5")) == [r for r in whole if r[0] in ("b09c02", "b09c03") and r[1] >= 1 and r[3] < 5]
    assert found.quads.filter("cell_id = 'nowhere'").count() == 0
    # Other cells' files and other passes' bytes are spoilt: nothing of them is opened.
    for name in ("c0.qdb", "c2.qdb", "c3.qdb", "c4.qdb"):
        (tmp_path / name).unlink()
    size = sum(18 * len(q) for _, _, subs in cells[1][3][:2] for _, _, q in subs) + len(b"SOMETHING") + 4
    (tmp_path / "c1.qdb").write_bytes((tmp_path / "c1.qdb").read_bytes()[:size])
    assert rows(asked) == want
    with pytest.raises(Exception, match="too short"):
        found.quads.filter("cell_id = 'b09c01' and pass = 2").collect()


def test_other_files_are_refused(spark, tmp_path):
    for bad in (b"", b"NOTHING", b"SOMETHINGINDEX\2\1"):
        with pytest.raises(ValueError):
            list(descriptors(bad))
    with pytest.raises(ValueError):
        read_packed_index(spark, f"file://{tmp_path}")
    write_index(tmp_path, "one.qdbindex", [("a.qdb", 1, 2, [(1.0, 2, [(1.0, 2.0, [])])])], "<")
    (tmp_path / "a.qdb").unlink()
    with pytest.raises(ValueError):
        read_packed_index(spark, f"file://{tmp_path}")
    assert len(records(b"")["r0"]) == 0
