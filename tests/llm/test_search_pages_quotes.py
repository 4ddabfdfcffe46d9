"""Top-k search, page texts, quotation links and the pipeline."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import SF
from llm.test_near_copies import brute_kept

from skyquad.llm import html_text, packing, queries, quotes, topk_search


def brute_top(rows, asked, k):
    """Over all rows (id, integer vector), by whole numbers of any size."""
    held = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    out = []
    for q in {i for i, _ in rows if asked(i)}:
        scored = sorted((-held(sum(int(a) * int(b) for a, b in zip(u, v))), i) for p, u in rows if p == q for i, v in rows if i != q)
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "group"), [(32, 7), (128, 20_000), (100_000, 20_000)])
def test_top_k_by_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    monkeypatch.setattr(topk_search, "QUERY_GROUP", group)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    base[50:80] = base[50]  # ties
    base[100:110] = 0
    rows = [(i, v.tolist(), "x") for i, v in enumerate(base)] + [(7, base[8].tolist(), "again"), (9, base[9].tolist(), ""), (20, base[3].tolist(), "a query's id again"), (300, base[4].tolist()[:5], "short")]
    odd = [(900, None, ""), (901, [1.0, None] + [0.0] * 6, ""), (902, [float("nan")] * 8, ""), (903, [float("inf")] * 8, ""), (None, base[0].tolist(), "")]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, block string")
    whole = [(i, np.floor(np.array(v, np.float32).astype(float) * 1024).astype(np.int64)) for i, v, _ in rows]
    found = sorted(tuple(r) for r in topk_search.top_k(vectors, vectors.filter("vec_id % 10 = 0")).collect())
    assert found == brute_top(whole, lambda i: i % 10 == 0, 10)
    few = vectors.filter("vec_id < 4")
    assert few.count() == 4 and topk_search.top_k(few, few).count() == 12
    assert topk_search.top_k(vectors.limit(0), vectors).count() == 0 and topk_search.top_k(vectors, vectors.limit(0)).count() == 0


def test_top_k_of_the_registered_query_with_repeated_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i % 150, rng.normal(size=6).astype(np.float32).tolist()) for i in range(400)] + [(100, [1.0] * 6)] * 30
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op2_exact_topk(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(found.columns)} FROM ({queries.ORACLES['op2_exact_topk']}) t").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) == 20


def test_top_k_beyond_64_bits(spark):
    rows = [(0, [1e30, 0.0]), (1, [1e30, 1.0]), (2, [-1e30, 5.0]), (3, [3e12, 2.0]), (4, [1.0, 7e11]), (5, [1.0, 2.0])] + [(i, [float(i), 1.0]) for i in range(6, 60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clamp = lambda x: min(max(int(x * 1024 // 1), -(1 << 63)), (1 << 63) - 1)
    whole = [(i, [clamp(x) for x in v]) for i, v in rows]
    found = sorted(tuple(r) for r in topk_search.top_k(vectors, vectors.filter("vec_id < 6"), 7).collect())
    assert found == brute_top(whole, lambda i: i < 6, 7)


PAGE = """<html><head><title>T</title><style>p {}</style></head><body><nav><a href=/>Home</a><a href=/b>Other</a></nav>
<div class="sidebar"><p>About this site and <a href=x>links</a></p></div>
<article><h1>A title</h1><p>First paragraph with   some words, an &amp; sign and <b>bold</b> text, long enough to count as text.</p>
<p>Second paragraph, also with many words in it, so that its density is high enough.<script>var x = "<p>no</p>";</script></p></article>
<div class="comments"><p>A reader's comment</p></div><footer>Imprint</footer></body></html>"""


def test_page_text_without_furniture(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, ""), (3, "v", "", ""), (4, "w", "plain words only", ""), (1, "u", PAGE, "y")], "page_id long, url string, html string, text string")
    found = html_text.extract_pages(pages).collect()
    got = {r.page_id: r for r in found}
    assert got[1].text.split("\n") == [
        "A title", "First paragraph with some words, an & sign and bold text, long enough to count as text.",
        "Second paragraph, also with many words in it, so that its density is high enough.",
    ]
    assert all(r.n_chars == len(r.text) for r in found) and len(found) == 5
    assert got[2].text == got[3].text == "" and got[4].text == "plain words only"
    assert html_text.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "deep" + "</div>" * 10, "<p>open <b>never closed", "<<>> & &# <a", "</div></p>text<br/>", "<!-- never ends", "<script>never ends", "<p>" + "x " * 100_000])
def test_broken_pages_are_read(page):
    assert isinstance(html_text.extract(page), str)


CONVERSATIONS = [
    (1, 0, "user", "How do I sort a list?\n\nThanks in advance"),
    (1, 1, "assistant", "> How do I sort a list?\n\nUse sorted()."),
    (1, 2, "user", "On Monday A wrote:\n> Use  SORTED().\n>> How do I sort a list?\n\nWorks."),
    (1, 3, "user", "> never said\n\nhm"),
    (1, 3, "user", "> Works.\nrepeated turn"),
    (2, 0, "user", None), (2, 1, "assistant", ""), (2, 2, "user", ">\n> \n"), (None, 0, "user", "> x"), (3, None, "user", "no turn"),
    (4, 0, "user", "yes"), (4, 1, "user", "> yes\n> a sentence nobody wrote\nno"), (4, 2, "user", "first\n> yes\nlast"), (4, 3, "user", "> last\nok"),
    (4, 4, "user", "> first\n> last\nboth lines of one message"), (4, 5, "user", "> yes\n> ok\nlines of two messages"), (4, 6, "user", "> yes"), (4, 7, "user", "x" * 50_000 + "\n> yes"),
    (3, 1, "user", "a\nb\nc"), (3, 2, "user", "> a\n> c\ntext"), (3, 3, "user", "  > b\nx\n\n\ny"), (3, 3, "user", "  > b\nx\n\n\ny"),
]


def test_quotes_link_to_their_originals(spark):
    table = spark.createDataFrame([(*r, "k", 1) for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, kind string, level int")
    found = quotes.link_quotes(table)
    rows = [tuple(r) for r in found.collect()]
    by_turn = {(r[0], r[1]): r for r in rows if r[0] == 1}
    assert by_turn[1, 1][3:] == ("Use sorted().", 1, 1, 0, 0, 1)
    assert by_turn[1, 2][3:] == ("Works.", 2, 2, 1, 0, 2)
    assert len(rows) == len(CONVERSATIONS)
    in_4 = {r[1]: r[4:7] for r in rows if r[0] == 4}
    assert in_4[1] == (1, 0, None) and in_4[3] == (1, 1, 2) and in_4[4] == (1, 1, 2) and in_4[5] == (1, 0, None) and in_4[6] == in_4[7] == (1, 1, 0)
    con = duckdb.connect()
    frame = pd.DataFrame(CONVERSATIONS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", frame)
    want = con.sql(f"SELECT {', '.join(found.columns)} FROM ({queries.ORACLES['op1_quotation_linking']}) t").fetchall()
    key = lambda r: tuple((v is not None, v or 0 if not isinstance(v, str) else 0, str(v)) for v in r)
    assert sorted(rows, key=key) == sorted(want, key=key)
    assert quotes.link_quotes(table.limit(0)).count() == 0


def test_long_reply_chains(spark):
    rows = [(1, i, "user", f"> line {i - 1}\nline {i}" if i else "line 0") for i in range(70)]
    found = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [(r.turn, r.thread_root, r.depth) for r in found.collect()] == [(i, 0, i) for i in range(70)]


def test_pipeline_stage_by_stage(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(1)
    extra = docs.limit(20).collect()
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, r.text if rng.random() < 0.7 else r.text + " end", *r[2:]) for i, r in enumerate(extra)] + [(10**7, None, "en", "s", 0), (10**7 + 1, "", "en", "s", 0)], docs.schema))
    kept = [docs]
    for name, stage in pipeline.STAGES:
        out = stage(spark, kept[-1], SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"{tmp_path}/{name}"))
    clean, unique, distinct, pieces = [k.collect() for k in kept[1:]]
    assert 0 < len(clean) <= docs.count()
    best = {}
    for r in clean:
        best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
    assert sorted(best.values()) == sorted(r.doc_id for r in unique)
    assert brute_kept({r.doc_id: r.text or "" for r in unique}) == {r.doc_id for r in distinct}
    assert {p.doc_id for p in pieces} == {r.doc_id for r in distinct}
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert all(p.length <= packing.WINDOW for p in pieces) and pipeline.ORACLE_SQL is None
