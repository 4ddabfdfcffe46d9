"""Operators on documents against brute force, with the odd rows that every one has to take."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyquad.llm import byte_bpe, exact_dedup, packing, piece_bpe, simhash, simple8b, token_binary, token_counts, toxicity
from skyquad.llm.components import components

SCHEMA = "doc_id long, text string, digest string, `_row` string, token string"
TEXTS = [
    None, "", " ", "one", "one two", "One  two\nthree", "the same text again and again", "the same text again and again", "x" * 5000,
    "<|endoftext|> special <|startoftext|> strings", "日本語のテキスト и кириллица ½ ǅ", "tab\tnew\r\nline  spaces   ", "emoji 🙂🙂 and 𝒳 é", "it's they'll WE'RE don't 12345 3.14",
    "   wide spaces　", "a\u0000b", "word " * 3000,
]


def documents(spark, texts=TEXTS, repeat=()):
    """With columns whose names clash with those that the operators use inside."""
    rows = [(i, t, "d", "r", "t") for i, t in enumerate(texts)] + [(i, texts[i], "d", "r", "t") for i in repeat]
    return spark.createDataFrame(rows, SCHEMA)


def whole(text):
    return text or ""


def test_token_counts_are_the_librarys(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = documents(spark, repeat=(5, 5))
    for size in (1, 9, 1 << 18):  # a chunk for each document, for some, for all of a task
        found = sorted(map(tuple, token_counts.token_counts(docs, chunk_size=size).collect()))
        ids = [*range(len(TEXTS)), 5, 5]
        counts = {i: len(library.encode(whole(TEXTS[i]), add_special_tokens=False).ids) for i in set(ids)}
        assert found == sorted((i, len(whole(TEXTS[i]).encode()), counts[i], counts[i] > 2048) for i in ids)
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def byte_ids(text):
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(whole(text), add_special_tokens=False).ids


def test_byte_ids_are_the_librarys():
    coder = byte_bpe.load(byte_bpe.default_path())
    for text in TEXTS:
        assert coder.encode(whole(text)).tolist() == byte_ids(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_byte_ids_of_any_text(text):
    assert byte_bpe.load(byte_bpe.default_path()).encode(text).tolist() == byte_ids(text)


def test_packing_places_every_id_once(spark):
    docs = documents(spark, repeat=(2,)).repartition(5)
    pieces = packing.pack(docs, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for i, text in enumerate(TEXTS):
        want = byte_ids(text) + [0]
        got = sorted(by_doc[i], key=lambda p: p.start)
        if i != 2:
            assert [v for p in got for v in np.frombuffer(bytes(p.ids), "<u4").tolist()] == want
            assert [p.start for p in got] == list(itertools.accumulate([0] + [p.length for p in got]))[:-1]
        assert all(p.doc_tokens == len(want) for p in got)
    assert len(by_doc[2]) == 2  # repeated rows are documents of their own
    for spans in by_sequence.values():
        ends = list(itertools.accumulate(n for _, n in sorted(spans)))
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(by_sequence) <= 1 + sum(len(byte_ids(t)) + 1 for t in TEXTS) // 700
    assert packing.pack(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80), st.integers(1, 6))
def test_open_windows_never_overflow(lengths, limit):
    windows, used = packing.OpenWindows(64, limit), Counter()
    for n in lengths:
        window, offset, emitted = windows.place(n)
        assert offset == used[window] and emitted != window
        used[window] += n
        assert used[window] <= 64 and len(windows.free) <= limit


def test_exact_duplicates_by_brute_force(spark):
    rng = random.Random(3)
    texts = [None if rng.random() < 0.1 else rng.choice(["a", "b", "", "c" * 4000, f"u{i}"]) for i in range(300)]
    docs = documents(spark, texts).unionByName(spark.createDataFrame([(None, "a", "", "", ""), (None, "only null", "", "", "")], SCHEMA))
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[whole(t)].append(i)
    groups["a"].append(None)
    groups["only null"].append(None)
    for counters in (2, 1024):
        found = exact_dedup.exact_duplicates(docs, counters).collect()
        assert len(found) == 302
        for r in found:
            text = "only null" if r.doc_id is None and r.group_size == 1 else "a" if r.doc_id is None else whole(texts[r.doc_id])
            best = max((i for i in groups[text] if i is not None), default=None)
            assert bytes(r.digest) == hashlib.sha256(text.encode()).digest()
            assert (r.keep_id, r.group_size, r.kept) == (best, len(groups[text]), r.doc_id == best)
    kept = exact_dedup.drop_exact_duplicates(docs, 2)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    same = documents(spark, ["z", "z"], repeat=(1, 1))
    assert exact_dedup.drop_exact_duplicates(same).count() == 1
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in whole(text))
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_definition(spark):
    got = {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(documents(spark)).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(TEXTS)}


def brute_components(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(prints), 2):
        if bin((prints[a] ^ prints[b]) & (2**64 - 1)).count("1") <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in prints}


@pytest.mark.parametrize("crowded", [1, 4096])
def test_links_by_brute_force(spark, crowded):
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(40)] + [0, 1, 3, 7, (1 << 63) | 1, 2**64 - 1]
    for p in prints[:30]:
        for _ in range(rng.randint(0, 3)):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), crowded).collect()}
    want = {tuple(sorted((a, b))) for (a, x), (b, y) in itertools.combinations(zip(signed, prints, strict=True), 2) if bin(x ^ y).count("1") <= 2}
    assert found == want


def test_near_duplicates_by_brute_force(spark):
    base = "many words make a long text whose fingerprint hardly moves when one of its words is changed " * 6
    texts = [*TEXTS, base, base + "tail", base + "other tail", base.upper(), "quite different words here now", ""]
    docs = documents(spark, texts)
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == brute_components(prints)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got.values())
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (2000, 2001), (2001, 2000)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 50)} | {2001: 2000}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 60) | st.just(0), max_size=1200), max_size=6))
def test_simple8b_round_trip(documents_):
    arrays = [np.array(d, dtype=np.uint64) for d in documents_]
    coded = simple8b.encode(arrays)
    if arrays:
        names = [None, -(1 << 63), 0, (1 << 63) - 1, None, 5][: len(arrays)]
        shard = simple8b.pack_shard(names, [len(a) for a in arrays], coded)
        ids, lengths, values = simple8b.unpack_shard(shard)
        assert ids == names and lengths.tolist() == [len(a) for a in arrays]
        assert values.tolist() == [v for d in documents_ for v in d]
        assert [simple8b.unpack_document(shard, i).tolist() for i in range(len(arrays))] == documents_


def test_token_shards_round_trip(spark):
    docs = documents(spark, repeat=(3,)).repartition(3)
    found = sorted(token_binary.token_shards(docs).collect(), key=lambda r: (r.doc_id, r.start))
    start = 0
    for r, i in zip(found, sorted([*range(len(TEXTS)), 3]), strict=True):
        ids = np.array(byte_ids(TEXTS[i]) + [2], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids))
        start += len(ids)
    nulls = spark.createDataFrame([(None, "x"), (1, None), (-(1 << 63), "y"), (None, "z")], "doc_id long, text string")
    assert [r.doc_id for r in token_binary.token_shards(nulls).orderBy("start").collect()] == [None, None, -(1 << 63), 1]
    assert token_binary.token_shards(docs.limit(0)).count() == 0


def test_shards_of_a_repeated_doc_id_and_single_documents(spark, tmp_path):
    rows = [(7, f"text {i} of the one id") for i in range(300)] + [(i, f"other {i}") for i in range(20)]
    folder = f"file://{tmp_path}/shards"
    manifest = token_binary.write_token_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder, shard_ids=64)
    shards = spark.read.parquet(folder)
    assert shards.groupBy("bucket").count().count() > 4 and shards.agg(F.max("n_tokens")).first()[0] < 200
    found = token_binary.read_token_shards(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted(i for i, _ in rows)
    assert [r.start for r in found] == list(itertools.accumulate([0] + [r.n_tokens for r in found]))[:-1]
    crc = lambda t: zlib.crc32(np.array(byte_ids(t) + [2], "<u4"))
    assert Counter((r.doc_id, r.ids_crc32) for r in found) == Counter((i, crc(t)) for i, t in rows)
    by_start = {r.start: r for r in found}
    for r in shards.join(manifest.select("bucket", "shard", "start"), ["bucket", "shard"]).collect():
        start = r.start
        for i in range(r.n_docs):
            ids = token_binary.read_document(bytes(r.data), i)
            assert zlib.crc32(ids) == by_start[start].ids_crc32 and len(ids) == by_start[start].n_tokens
            start += len(ids)


def test_pieces_are_the_librarys(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = {r.doc_id: r for r in piece_bpe.encode_documents(documents(spark), with_ids=True).collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode(whole(text))
        assert found[i].ids == ids and found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert piece_bpe.encode_documents(documents(spark).limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("aeinrst ▁.,ÀéB0\n", max_size=60))
def test_pieces_of_any_text(text):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    coder = piece_bpe.load(piece_bpe.default_path())
    ids = library.encode(text)
    assert coder.encode(text) == ids and coder.decode(ids) == library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.0, 0.0, 2.0, 3.5, 2.5]), max_size=40))
def test_segments_are_all_maximal_ones(weights):
    values = [w or -1.0 for w in weights]
    sums = [0.0, *itertools.accumulate(values)]
    got = toxicity.segments([(i, sums[i], sums[i + 1]) for i, v in enumerate(values) if v > 0])

    def best(lo, hi):  # the definition: the best segment, the shortest of equals, then what is left and right of it
        spans = [(sum(values[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
        top = max(spans, default=None)
        if top is None or top[0] <= 0:
            return []
        return best(lo, top[3]) + [round(top[0], 6)] + best(top[4], hi)

    assert sorted(round(s, 6) for _, _, s in got) == sorted(best(0, len(values)))


def brute_weight(texts, labels, word, base):
    """The weight of a word by its definition, over all documents."""
    words = [set(toxicity._words(t.lower())) for t in texts]

    def rate(size):
        if size == 0:
            return base
        prior = rate(max((n for n in toxicity.PREFIXES if n < size), default=0))
        has = [any(len(w) >= size and w[:size] == word[:size] for w in ws) for ws in words]
        return (sum(y for h, y in zip(has, labels) if h) + toxicity.STRENGTH * prior) / (sum(has) + toxicity.STRENGTH)

    has = [word in ws for ws in words]
    prior = rate(max((n for n in toxicity.PREFIXES if n <= len(word)), default=0))
    r = (sum(y for h, y in zip(has, labels) if h) + toxicity.STRENGTH * prior) / (sum(has) + toxicity.STRENGTH)
    return np.log(r / (1 - r)) - np.log(base / (1 - base))


def test_weights_by_definition(spark):
    rng = random.Random(8)
    vocabulary = ["a", "abc", "abcd", "abcde", "abcdef", "abcdefg", "abcdefgh", "abcdxyz", "other", "otherwise", "x" * 80, "x" * 79 + "y", "é", "日本語の文"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6))) for _ in range(80)]
    toxic = [rng.randint(0, 1) for _ in texts]
    rows = spark.createDataFrame([(t, y, i % 2) for i, (t, y) in enumerate(zip(texts, toxic))], "text string, toxic int, fold int")
    counts = rows.mapInArrow(toxicity._count, "feature string, c0 long, t0 long, c1 long, t1 long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")])
    found = {r.hash % (1 << 64): r for r in toxicity.feature_weights(counts, 0.3).collect()}
    for word in vocabulary:
        r = found[toxicity._hash("=" + word)]
        assert r.w == pytest.approx(brute_weight(texts, toxic, word, 0.3), rel=1e-5)
        assert r.w0 == pytest.approx(brute_weight(texts[1::2], toxic[1::2], word, 0.3), rel=1e-5)
    hashes = np.array(sorted(found), dtype=np.uint64)
    weights = toxicity.Weights(hashes, np.array([found[int(h)].w for h in hashes]))
    asked = ["abcdef", "abcdefzz", "abcdez", "abcdz", "abz", "unknown", "x" * 81]
    features = ["=abcdef", "6abcdef", "5abcde", "4abcd", None, None, "6xxxxxx"]
    assert weights.of(asked).tolist() == pytest.approx([found[toxicity._hash(f)].w if f else 0.0 for f in features])


def test_extreme_values_are_found_again():
    rng = np.random.default_rng(2)
    n = rng.integers(50, 3000, 20_000)
    best = -np.log(-np.log(rng.random(20_000)) / (0.02 * n)) / 1.7
    assert toxicity.extreme_values(n, best) == pytest.approx((1.7, 0.02), rel=0.05)


def test_toxicity_learns_and_leaves_clean_rows_alone(spark):
    rng = random.Random(5)
    plain, bad = [f"plain{i}" for i in range(200)], [f"nasty{i}" for i in range(12)]
    texts, toxic = [], []
    for _ in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        toxic.append(int(rng.random() < 0.2))
        if toxic[-1]:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(bad) for _ in range(8)]
        texts.append(" ".join(words))
    docs = documents(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(5, 1, toxic[5]), (None, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in found.items() if r.held_out} >= set(held) and 50 < len(held) < 200
    assert sum(found[i].predicted != toxic[i] for i in held) <= 0.03 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    assert found[600].predicted == 0 and found[600].score == found[601].score
    assert all((r.predicted == 0) or r.passages for r in found.values())
    mostly = labels.withColumn("toxic", F.coalesce(F.lit(1) * (F.col("doc_id") % 4 != 0).cast("int"), "toxic"))
    assert all(r.predicted == 0 for r in toxicity.score_documents(docs, mostly).collect() if not r.passages)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in found.values())
    one_kind = labels.withColumn("toxic", F.lit(0))
    assert toxicity.score_documents(docs, one_kind).filter("predicted = 1").count() == 0
    assert toxicity.score_documents(docs, labels.limit(0)).count() == 602
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_toxicity_of_long_words_long_texts_and_repeated_rows(spark):
    """Long words are learned like others; a doc_id with very many rows trains once."""
    rng = random.Random(6)
    plain = [f"plain{i}" for i in range(100)]
    long_word = "nasty" * 20
    rows = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(40)]
        rows.append((i, " ".join(words + [long_word] * (i % 5 == 1))))
    rows += [(7, "one of many rows " + str(k)) for k in range(50)] + [(1000, "plain1 " * 200_000), (1001, "plain2 " * 50_000 + long_word), (None, long_word), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(400)], "doc_id long, toxic int")
    assert toxicity._training_rows(docs, labels, 10_000).count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(400))
    found = toxicity.score_documents(docs, labels).collect()
    assert len(found) == len(rows)
    scores = {(r.doc_id, r.predicted) for r in found}
    assert {p for i, p in scores if i in (6, 11, 21)} == {1} and (1000, 0) in scores and {p for i, p in scores if i is None} == {0, 1}
    best = next(r for r in found if r.doc_id == 1001)
    assert best.passages and all(p.first_token == p.last_token == 50_000 for p in best.passages)
