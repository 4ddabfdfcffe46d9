"""Toxicity by maximum-scoring segments of token log-odds.

Model. For each word and each word prefix of a few lengths, training documents with it are counted
by label. A word's rate of toxic documents has a Dirichlet prior centred on the rate of its longest
prefix, whose own prior is centred on the next shorter one, and so on up to the base rate; the
word's weight is the log-odds of that rate against the base rate, positive or negative. Words the
model doesn't know inherit the weight of their longest known prefix. All words and prefixes of the
training documents are in the model: a 64-bit hash and a number each.

Scan. A token scores its weight less ``DRIFT`` = log 2, so only tokens that make toxicity more than
twice as likely raise a sum; a word's k-th occurrence in a text counts 1 / k of such a weight, as words
repeat in bursts. One linear pass over a text finds all maximal-scoring segments. Against clean
documents the best segment of n tokens has an extreme-value distribution, ``P(S > x) = 1 - exp(-K n
exp(-lambda x))``, fitted by maximum likelihood; a segment is significant if fewer than one like it is
expected by chance, and counts with ``lambda x - log(K n)``. The sum over the segments of a
document is calibrated to a probability by logistic regression. A text without any significant
segment is never predicted toxic, however many training documents are.

Training reads labelled rows only: those whose crc32(doc_id) mod 5 is not 0, at most about
``TRAIN_DOCS`` of them, chosen by a hash. Extreme values and calibration are cross-fitted: a
document's segments come from weights learned on the other half of the training documents.

Rules: a null or empty text has no segment and gets the score of no evidence. Of several labels of
a doc_id the most toxic counts, and of several texts of a doc_id one trains; rows without label or
doc_id train nothing, and all rows are scored, over their whole text. Without labels of both kinds
every score is 0, or just under 0.5 where all labels are toxic. Only text is an input of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, whole_row, whole_text

TRAIN_DOCS = 24_000
PREFIXES = (4, 5, 6)
STRENGTH = 8.0  # of the prior, in documents
DRIFT = math.log(2)
NO_EVIDENCE = 0.49  # the highest score of a text without a significant segment
_SEEN = 200_000  # words whose weight a Python worker remembers
_HASHED = 1 << 53  # hashes of training rows are compared as fractions of this

_words = re.compile(r"\w+").findall


def segments(hits: list[tuple[int, float, float]]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, score), left to right.

    ``hits``: position, and sum of all scores before and with the token, for each token of a positive
    score, ascending. Linear time: a segment remembers the last one before it that starts lower.
    Of segments with equal scores the shorter one counts.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, lower one
    for at, before, total in hits:
        first = at
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                stack.append((first, at, before, total, j))
                break
            first, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(first, last, after - before) for first, last, before, after, _ in stack]


def _hash(feature: str) -> int:
    """As Spark's ``xxhash64`` of one string."""
    return xxhash.xxh64_intdigest(feature.encode("utf-8", "surrogatepass"), 42)


@dataclass
class Weights:
    """Weights by the hash of a feature: ``=word``, or a prefix with its length before it."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # ascending
    values: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def of(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        if not len(self.hashes):
            return out
        todo = np.arange(len(words))
        for length in (0, *reversed(PREFIXES)):
            names = [f"{length}{words[i][:length]}" if length else "=" + words[i] for i in todo if len(words[i]) >= length]
            asked = np.array([i for i in todo if len(words[i]) >= length], dtype=np.int64)
            hashes = np.array([_hash(n) for n in names], dtype=np.uint64)
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            out[asked[known]] = self.values[at[known]]
            todo = np.setdiff1d(todo, asked[known], assume_unique=True)
        return out


def scan(text: str, weights: Weights, seen: dict[str, float]) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens, and segments by token position. ``seen``: weights that are known already."""
    words = _words(text.lower())
    if not words:
        return 0, []
    found = list(map(seen.get, words))
    if None in found:
        new = list({w for w, v in zip(words, found, strict=True) if v is None})
        known = dict(zip(new, weights.of(new).tolist(), strict=True))
        found = [known[w] if v is None else v for w, v in zip(words, found, strict=True)]
        if len(seen) < _SEEN:
            seen.update(known)
    scores = np.array(found) - DRIFT
    hits = np.flatnonzero(scores > 0)
    times: Counter = Counter()
    for i in hits.tolist():
        times[words[i]] += 1
        if times[words[i]] > 1:
            scores[i] = (scores[i] + DRIFT) / times[words[i]] - DRIFT
    sums = np.cumsum(scores)
    hits = hits[scores[hits] > 0]
    return len(words), segments(list(zip(hits.tolist(), (sums[hits] - scores[hits]).tolist(), sums[hits].tolist(), strict=True)))


@dataclass
class Model:
    weights: Weights = field(default_factory=Weights)
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    calibration: tuple[float, float, float] = (-9.0, 0.0, 0.0)

    def evidence(self, n_words: int, score: float) -> float:
        """Of one segment; 0 if it isn't significant."""
        return max(0.0, self.rate * score - math.log(max(self.scale * max(n_words, 1), 1e-12)))

    def passages(self, text: str, seen: dict[str, float]) -> list[tuple[int, int, float]]:
        """The significant segments: first and last token, evidence."""
        n, found = scan(text, self.weights, seen)
        out = [(first, last, self.evidence(n, score)) for first, last, score in found]
        return [p for p in out if p[2] > 0]

    def probability(self, evidence: float) -> float:
        a, b, c = self.calibration
        z = a + (b + c * math.log1p(evidence) if evidence > 0 else 0.0)
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        return p if evidence > 0 else min(p, NO_EVIDENCE)


def _training_rows(docs: DataFrame, labels: DataFrame, at_most: int) -> DataFrame:
    """text, toxic, fold: about ``at_most`` rows."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    share = min(1.0, at_most / max(known.count(), 1))
    dealt = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(_HASHED)) / F.lit(float(_HASHED))
    known = known.filter(dealt < share).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)).cast("int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    # About at_most rows of three numbers: small by the parameter.
    rows = stash(texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic", "fold"), "training")
    if rows.agg(F.count(F.lit(1)) > F.count_distinct("doc_id")).first()[0]:
        rows = stash(rows.groupBy("doc_id", "toxic", "fold").agg(F.max("text").alias("text")), "training")
    return rows.select("text", "toxic", "fold")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training documents with each word and prefix, by fold and label."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        names = list({f for f, _, _ in held})
        columns = [[held[f, fold, toxic] for f in names] for fold in (0, 1) for toxic in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(names)] + [pa.array(c, pa.int64()) for c in columns], ["feature", "c0", "t0", "c1", "t1"])

    for batch in batches:
        for text, toxic, fold in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            words = set(_words(text.lower()))
            names = {"=" + w for w in words} | {f"{n}{w[:n]}" for w in words for n in PREFIXES if len(w) >= n}
            held.update((f, fold, toxic) for f in names)
            if len(held) > 300_000:
                yield out()
                held.clear()
    if held:
        yield out()


def feature_weights(counts: DataFrame, base: float) -> DataFrame:
    """hash, w0, w1, w: the weights of each feature by the documents of fold 1, of fold 0 (for documents
    of the other fold), and of both. ``counts``: feature and its clean and toxic documents by fold."""
    models = {"w0": ("1",), "w1": ("0",), "w": ("0", "1")}
    odds = math.log(base / (1 - base))

    def rated(level: DataFrame, prior) -> DataFrame:
        """Adds rates r_w0, r_w1, r_w, given a function from their names to priors."""
        out = {}
        for name, folds in models.items():
            toxic = sum((F.col(f"t{f}") for f in folds), F.lit(0))
            both = sum((F.col(f"c{f}") for f in folds), toxic)
            out[f"r_{name}"] = (toxic + STRENGTH * prior(f"r_{name}")) / (both + STRENGTH)
        return level.withColumns(out)

    named = counts.withColumn("text", F.substring("feature", 2, 1 << 30)).withColumn("kind", F.substring("feature", 1, 1))
    levels, before = [], None
    for length in (*PREFIXES, 0):
        level = named.filter(F.col("kind") == (str(length) if length else "="))
        if before is None:
            level = rated(level, lambda name: F.lit(base))
        else:
            # Parents: a prefix's next shorter one; a word's longest one, found by that prefix itself.
            longest = F.least(F.length("text"), F.lit(max(PREFIXES))) if not length else F.lit(max(n for n in PREFIXES if n < length))
            level = level.withColumn("parent", F.concat(longest.cast("string"), F.expr("substring(text, 1, least(length(text), 6))") if not length else F.expr(f"substring(text, 1, {max(n for n in PREFIXES if n < length)})")))
            parents = before.select(F.col("feature").alias("parent"), *[F.col(f"r_{m}").alias(f"p_{m}") for m in models])
            level = rated(level.join(parents, "parent", "left"), lambda name: F.coalesce(F.col("p_" + name[2:]), F.lit(base)))
        level = level.select("feature", *[f"r_{m}" for m in models])
        levels.append(level)
        before = level if before is None or not length else before.unionByName(level)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    logit = lambda r: (F.log(r / (1 - r)) - odds).cast("float")
    return every.select(F.xxhash64("feature").alias("hash"), *[logit(F.col(f"r_{m}")).alias(m) for m in models])


def extreme_values(lengths: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """(lambda, K) by maximum likelihood, from length and best segment of clean documents."""
    n, x = np.maximum(lengths, 1).astype(float), best.astype(float)

    def scale(rate: float) -> float:
        return len(n) / float((n * np.exp(-rate * x)).sum())

    def likelihood(rate: float) -> float:
        return len(n) * math.log(rate * scale(rate)) - rate * float(x.sum()) - len(n)

    low, high = 0.05, 20.0
    for _ in range(60):  # one maximum: golden section
        a, b = high - (high - low) * 0.618034, low + (high - low) * 0.618034
        low, high = (a, high) if likelihood(a) < likelihood(b) else (low, b)
    return low, scale(low)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a weak ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w)), x.T @ (y - p) - 0.05 * w)
        w += step
        if abs(step).max() < 1e-6:
            break
    return w


def _scanned(weights):
    """Per training document: its segments under the other fold's weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, *values = weights.value
        halves, seen = [Weights(hashes, v) for v in values], [{}, {}]
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
            found = [(toxic, *scan(text, halves[fold], seen[fold])) for text, toxic, fold in rows]
            columns = [[t for t, _, _ in found], [n for _, n, _ in found], [max((s for _, _, s in segs), default=0.0) for _, _, segs in found], [[s for _, _, s in segs] for _, _, segs in found]]
            kinds = [pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["toxic", "n", "best", "scores"])

    return run


def train(docs: DataFrame, labels: DataFrame, at_most: int = TRAIN_DOCS) -> Model:
    spark = docs.sparkSession
    rows = _training_rows(docs, labels, at_most)
    by_label = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(by_label) < 2:
        return Model(calibration=(9.0 if 1 in by_label else -30.0, 0.0, 0.0))
    base = by_label[1] / sum(by_label.values())
    counts = rows.mapInArrow(_count, "feature string, c0 long, t0 long, c1 long, t1 long").groupBy("feature")
    counts = stash(counts.agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")]), "features")
    # 20 bytes for each word and prefix of at_most documents.
    table = feature_weights(counts, base).toArrow()
    hashes = table.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes, half_0, half_1, both = hashes[order], *[table.column(m).to_numpy()[order] for m in ("w0", "w1", "w")]
    held = spark.sparkContext.broadcast((hashes, half_0, half_1))
    scanned = stash(rows.mapInArrow(_scanned(held), "toxic int, n long, best double, scores array<double>"), "scanned")
    clean = scanned.filter("toxic = 0").select("n", "best").toArrow()  # two numbers for each of at_most rows
    model = Model(Weights(hashes, both), *extreme_values(clean.column("n").to_numpy(), clean.column("best").to_numpy()))
    chance = F.log(F.greatest(model.scale * F.greatest("n", F.lit(1)), F.lit(1e-12)))
    evidence = F.aggregate("scores", F.lit(0.0), lambda total, s: total + F.greatest(model.rate * s - chance, F.lit(0.0)))
    found = scanned.select("toxic", evidence.alias("e")).toArrow()
    e = found.column("e").to_numpy()
    x = np.stack([np.ones(len(e)), e > 0, np.where(e > 0, np.log1p(e), 0)], axis=1).astype(float)
    a, b, c = _logistic(x, found.column("toxic").to_numpy().astype(float))
    model.calibration = (float(a), float(b), max(float(c), 0.0))  # more evidence never lowers a score
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


_PASSAGE = pa.struct([("first_token", pa.int32()), ("last_token", pa.int32()), ("evidence", pa.float64())])


def _scored(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = held.value, {}
        for batch in batches:
            found = [model.passages(t.as_py(), seen) for t in batch.column("text")]
            scores = pa.array([model.probability(sum(e for _, _, e in p)) for p in found], pa.float64())
            passages = pa.array([[{"first_token": a, "last_token": b, "evidence": e} for a, b, e in p] for p in found], pa.list_(_PASSAGE))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores, passages], ["doc_id", "score", "passages"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and passages (of every significant segment its first and
    last token and its evidence) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # 12 bytes for each feature of TRAIN_DOCS documents
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.mapInArrow(_scored(held), "doc_id long, score double, passages array<struct<first_token: int, last_token: int, evidence: double>>")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their columns, whatever their names."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, seen = held.value, {}
        for texts in batches:
            yield pd.Series([model.probability(sum(e for _, _, e in model.passages(t, seen))) for t in texts], dtype=float)

    rows = docs.select(whole_row(docs).alias("row"), F.pandas_udf(scored, "double")(whole_text()).alias("score"))
    return rows.filter("score < 0.5").select("row.*")
