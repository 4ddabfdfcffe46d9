"""Line dedup, importance resampling and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyquad.llm import line_dedup, resampling, spelling
from skyquad.llm.queries import ORACLES

SCHEMA = "doc_id long, text string, h1 string, `row` string, word string, n string, gone string, `lines` string"
SPACE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, rows):
    """With columns whose names clash with those that the operators use inside."""
    return spark.createDataFrame([(i, t, *["x"] * 6) for i, t in rows], SCHEMA)


LINES = [
    (0, "A shared line here\nown one, short\n\n  a SHARED line here\t\nend"), (1, "a shared line here\nunique to document one"), (2, None), (3, ""), (4, "short\nshort\nshort"),
    (5, "short"), (5, "a shared line here\nanother text of five, once"), (6, "x\r\na shared line here\r\ny"), (7, "\n\n"), (8, "only in eight, twice\nonly in eight, twice"),
    (8, "only in eight, twice\nonly in eight, twice"), (9, "É shared accents\né shared accents"), (10, "É shared accents"), (None, "line without an id\na shared line here"), (None, "line without an id"),
    (11, "line without an id"), (12, "b" * 200_000 + "\n" + "é" * 10 + "\n" + "é" * 9), (13, "é" * 9 + "\n" + "é" * 10), (14, "a shared line here"), (15, " a shared line here"),
]


def dropped_by_definition(rows, least=2):
    held = defaultdict(set)
    key = lambda x: x.strip(SPACE).translate(UPPER)
    first = lambda i: (i is None, i or 0)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(first(i))
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < least or min(held[key(x)]) == first(i)]
        yield i, "\n".join(kept), len(lines), len(lines) - len(kept)


@pytest.mark.parametrize("least", [2, 4])
def test_lines_by_definition(spark, least):
    found = line_dedup.dedup_lines(documents(spark, LINES), least_documents=least).collect()
    order = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    assert sorted(map(tuple, found), key=order) == sorted(dropped_by_definition(LINES, least), key=order)


def test_lines_of_no_rows_and_without_python(spark):
    assert line_dedup.dedup_lines(documents(spark, LINES).limit(0)).count() == 0
    plan = line_dedup.dedup_lines(documents(spark, LINES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_lines_of_long_documents(spark):
    """Every other line of 60,000 goes: linear in the lines."""
    shared = [f"shared line number {i}" for i in range(30_000)]
    rows = [(1, "\n".join(shared)), (2, "\n".join(x for i, s in enumerate(shared) for x in (s, f"own {i}")))]
    found = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert (found[1].n_dropped, found[2].n_dropped) == (0, 30_000)
    assert found[2].text == "\n".join(f"own {i}" for i in range(30_000))


def test_lines_agree_with_sql(spark):
    rows = [(i, t) for i, t in LINES if i is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    cols = "doc_id, n_lines, n_dropped, kept_sha256"
    found = line_dedup.dedup_lines(documents(spark, rows)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(f"SELECT {cols} FROM ({ORACLES['op13_line_dedup']})").fetchall())


# Importance resampling


def features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def drawn_by_definition(docs, target, percent, least, longest, buckets):
    count = lambda texts: Counter(f % buckets for t in texts for f in features(t, longest)[1])
    mine, theirs = count(t for _, t in docs), count(target)
    s_all, t_all = sum(mine.values()), sum(theirs.values())
    gain = lambda b: math.floor(1000 * math.log(((theirs[b] + 1) * (s_all + buckets)) / ((mine[b] + 1) * (t_all + buckets))))
    out = []
    for i, t in docs:
        n, own = features(t, longest)
        weight = sum(gain(f % buckets) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(order[: percent * len(order) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in out]


def some_texts(n, seed=5):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "δέλτα", "42", "x1y2", "naïve", "ΣΑΣ", "it's"]
    rows = [(i, " ".join(rng.choices(words, weights=range(1, 10), k=rng.choice([0, 3, 19, 20, 21, 60])))) for i in range(n)]
    return [*rows, (n, None), (n + 1, "word," * 150_000), (n + 2, "　…"), (None, "beta " * 25), (3, "beta " * 30), (3, "beta " * 30)]


def same(found, wanted):
    """Of documents of equal score and doc_id, which has which of their ranks is open."""
    order = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    assert sorted(map(tuple, found), key=order) == sorted(wanted, key=order)


@pytest.mark.parametrize(("percent", "longest", "buckets", "run", "part"), [(10, 1, 10_000, 1 << 20, 1 << 18), (60, 2, 50, 7, 10), (100, 3, 70_000, 16, 1), (37, 1, 1, 3, 5)])
def test_draws_by_definition(spark, percent, longest, buckets, run, part):
    docs, target = some_texts(200), ["gamma gamma δέλτα 42", None, "", "x1y2 " * 9]
    found = resampling.resample(documents(spark, docs).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), percent, 20, longest, buckets, run_size=run, range_size=part)
    same(found.collect(), drawn_by_definition(docs, target, percent, 20, longest, buckets))


def test_draws_of_equal_scores_are_split_by_doc_id(spark):
    """One score for all: ranges end within it, and ranks are those of the doc_ids."""
    rows = [(i, (i * 7919) % 1000 if i % 50 else None, 5) for i in range(1000)]
    ranked = resampling.draw_ranked(spark.createDataFrame(rows, "row long, doc_id long, score long").repartition(7), 45, 30, 40).collect()
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))[:450]
    assert sorted((r["rank"], r["row"]) for r in ranked) == [(k + 1, r[0]) for k, r in enumerate(order)]


def test_draws_of_nothing(spark):
    none = documents(spark, [(1, "a")]).limit(0)
    assert resampling.resample(none, none).count() == 0
    assert [tuple(r) for r in resampling.resample(documents(spark, [(1, "a")]), none).select("rank").collect()] == [(None,)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(-5, 5), st.integers(0, 9))), max_size=9))
def test_tournament_merges(runs):
    assert list(resampling.Tournament([iter(sorted(r)) for r in runs])) == sorted(x for r in runs for x in r)


# Spelling variants


def words_by_definition(docs, least_count=3, one_in=97):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    forms, counts = {}, {}
    for w in n:
        found = [v for v in n if near(w, v)]
        counts[w] = len(found)
        best = min(found, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        yield w, forms[w], root, n[w], counts[w], n.get(forms[w])


@pytest.mark.parametrize("one_in", [97, 3])
def test_variants_by_definition(spark, one_in):
    rng = random.Random(7)
    bases = ["spelling", "Étoile", "aaaaa", "aabbb", "abbbb", "abcab", "ababab", "bababa", "mississippi", "straße", "ÀÀÀÀÀÀ"]
    docs = []
    for i in range(120):
        words = []
        for _ in range(40):
            w = rng.choice(bases)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "a", "b", "é", w[at] * 2]) + w[at + rng.choice([0, 1]) :]
            words.append(w.upper() if rng.random() < 0.2 else w)
        docs.append((i, rng.choice([" ", "-", "×1"]).join(words)))
    docs += [(None, "spelling spelling speling"), (5, "Étoile etoile"), (200, None), (201, "")]
    found = spelling.spelling_variants(documents(spark, docs), one_in=one_in).collect()
    assert len(found) > 100 and sum(r.root != r.form for r in found if r.form) > 5
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, words_by_definition(docs, one_in=one_in)))


def test_variants_of_words_of_any_length(spark):
    """A run of a hundred thousand letters has as many deletions; its keys stay in proportion to it."""
    long = "ab" * 50_000
    rows = [(i, long) for i in range(6)] + [(i, long[:99] + "z" + long[100:]) for i in range(10, 13)] + [(i, long + "c") for i in range(20, 23)]
    rows = [(i, t) for i, t in rows if zlib.crc32(f"{i}:{t}".encode()) % 97]
    assert len(rows) == 12
    found = {r.n: r for r in spelling.spelling_variants(documents(spark, rows), least_count=1).collect() if r.n == 6} | {r.word[-1]: r for r in spelling.spelling_variants(documents(spark, rows)).collect() if r.n == 3}
    assert (found[6].n_near, found[6].form_n, found["c"].n_near, found["c"].form_n, found["b"].n_near, found["b"].form_n) == (2, None, 1, 6, 1, 6)
    assert all(r.root == long for r in found.values())


def test_variants_of_no_rows(spark):
    assert spelling.spelling_variants(documents(spark, [(1, "a")]).limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abÿ", min_size=1, max_size=7), min_size=1, max_size=8))
def test_keys_are_equal_where_strings_are(words):
    k1, k2, word, place, last = spelling.deletion_keys(words)
    seen = defaultdict(set)
    for a, b, w, i, j in zip(k1, k2, word, place, last, strict=True):
        text = words[w] if i < 0 else words[w][:i] + words[w][i + 1 :]
        seen[text, len(text)].add((a, b))
        assert i < 0 or len(set(words[w][i : j + 1])) == 1
    assert all(len(k) == 1 for k in seen.values())
    assert len({(k, t[1]) for t, ks in seen.items() for k in ks}) == len(seen)
    assert Counter(word.tolist()) == {w: 1 + len({words[w][:i] + words[w][i + 1 :] for i in range(len(words[w]))}) for w in range(len(words))}


def test_power_tables_reach_any_length():
    powers = spelling._Powers().to(3000)
    assert [int(powers[0, i]) for i in (0, 1, 2, 2999)] == [pow(spelling._BASES[0], i, int(spelling._PRIMES[0, 0])) for i in (0, 1, 2, 2999)]
    assert powers.dtype == np.uint64
