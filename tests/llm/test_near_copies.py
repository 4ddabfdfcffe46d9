"""The pipeline's near-dedup stage against brute-force Jaccard similarity."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest
from conftest import SF

from skyquad.llm import exact_dedup, near_copies, simhash, toxicity


def brute_kept(texts):
    """Ids that stay of {doc_id: text}."""
    sets = {}
    for i, text in texts.items():
        words = text.lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i for i in sets if root[i] == i}


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(40)]
    texts = []
    for i in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(4, 120))]
        if i % 3 == 0:
            base[0:0] = passage
        texts.append(base)
        for _ in range(12 if i == 5 else 3):  # a chain of copies, each with some words changed
            base = list(base)
            for _ in range(rng.randint(0, 4)):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(base)
    rng.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate([*texts, [], ["One"], ["one"], ["one", "two"]])}


@pytest.fixture
def broadcasts(spark, request):
    """The largest table that Spark broadcasts: with -1 every join shuffles."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize(("busy", "broadcasts", "crowd"), [(4, "10m", 32), (0, "-1", 2), (1, "10m", 2)], indirect=["broadcasts"])
def test_near_copies_by_brute_force(spark, monkeypatch, busy, broadcasts, crowd):
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    texts = corpus()
    docs = spark.createDataFrame([*texts.items(), (None, texts[0]), (None, "a text that only the row without an id has")], "doc_id long, text string")
    marks = near_copies.near_components(docs, busy=busy).collect()
    want = brute_kept(texts)
    assert {r.doc_id for r in marks if r.stays} == want | {None} and len(want) < len(texts) - 30
    assert len(marks) == len(texts) + 2 and sum(r.stays for r in marks) == len(want) + 1
    if busy == 4:
        kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted(want)
        assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), SF).count() == 0


def test_parities_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 5, 31, 32, 33, 200, 1000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 3], rng.integers(0, 2**64, n // 3, dtype=np.uint64)]))
        x, y = near_copies.parities(a), near_copies.parities(b)
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        assert len(x) == len(y) and 64 * len(x) >= 2 * len(b)
        assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(np.setxor1d(a, b))


LONG = " ".join(f"word{i}" for i in range(60))
OTHER = " ".join(f"other{i}" for i in range(60))
ROWS = [(1, LONG), (3, OTHER), (3, LONG + " end"), (5, OTHER), (5, OTHER), (None, OTHER), (None, "alone"), (None, "alone"), (9, ""), (10, None), (11, " \n"), (12, "x" * 200_000)]
CLASHING = "doc_id long, text string, `_digest` string, digest string, node int, `root` int, stays string, `_gone` string, `_toxic` double, `row` string, `score` int, `a.b` string"


@pytest.mark.parametrize("drop", [near_copies.drop_near_copies, simhash.drop_near_duplicates, exact_dedup.drop_exact_duplicates])
def test_rows_are_decided_one_by_one_and_keep_their_columns(spark, drop):
    """Rows that repeat a doc_id, rows without one, and columns whose names the operators use."""
    docs = spark.createDataFrame([(*r, "d", "e", 1, 2, "s", "g", 0.5, "r", 3, "p") for r in ROWS], CLASHING)
    kept = drop(docs).collect()
    assert drop(docs).columns == docs.columns and all(r[2:] == ("d", "e", 1, 2, "s", "g", 0.5, "r", 3, "p") for r in kept)
    found = sorted(((r.doc_id or 0), (r.text or "").strip()[:9]) for r in kept)
    if drop is exact_dedup.drop_exact_duplicates:
        assert found == sorted([(1, "word0 wor"), (3, "word0 wor"), (5, "other0 ot"), (0, "alone"), (10, ""), (11, ""), (12, "x" * 9)])
    elif drop is near_copies.drop_near_copies:
        assert found == sorted([(1, "word0 wor"), (3, "other0 ot"), (0, "alone"), (9, ""), (12, "x" * 9)])
    else:  # by fingerprints: no text is lost whose fingerprint no kept row is linked to
        prints = {simhash.fingerprint(r.text or "") for r in kept}
        assert all(any((simhash.fingerprint(t or "") ^ p).bit_count() <= 4 for p in prints) for _, t in ROWS)
        assert (3, "other0 ot") in found and len(found) == len(prints)


def test_toxic_rows_go_with_clashing_columns(spark):
    docs = spark.createDataFrame([(*r, "d", "e", 1, 2, "s", "g", 0.5, "r", 3, "p") for r in ROWS], CLASHING)
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
