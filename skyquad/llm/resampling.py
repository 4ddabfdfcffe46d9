"""Importance resampling towards a target distribution.

Features are runs of one to ``MAX_WORDS`` consecutive words, hashed into ``BUCKETS`` buckets. What
share of a bucket the target texts hold against all documents is its gain, and the gains are an
array: a document's weight is the mean of the array's entries at its features. A Gumbel variate from
a hash of the doc_id is added, and the highest scores are drawn, which samples without replacement
in proportion to the weights.

1. One pass over the texts writes each document's buckets, two bytes for a feature of up to 65,536
   buckets. The buckets' counts are summed from them.
2. With the gains, ``BUCKETS`` numbers, every document is scored.
3. Every partition sorts its eligible documents into runs of at most ``RUN``. A count of documents
   per score shows which scores can be drawn at all; they are cut into ranges of about ``RANGE``
   documents, by score and, where very many share one score, by doc_id. A run becomes one sorted
   slice for each range, written to the shared folder.
4. The slices of a range are merged by a tournament tree, which stops at the exact number that is left
   to draw there, and gives ranks from the number of documents in the ranges before.

What the driver sees are ``BUCKETS`` gains, one count per different score (scores are whole numbers
within some hundred thousand, whatever the number of documents), and one count per range.

Rules: a null text has no words. A document without features has weight 0. Rows that repeat a doc_id
are documents of their own; documents of equal score and doc_id come in the order of their rows.
A null doc_id is hashed as an empty one and comes after all others of its score. Empty documents
give an empty result; an empty target is a target without features. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, whole_text

MAX_WORDS = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
RUN = 1 << 20
RANGE = 1 << 18
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # over lower-cased UTF-8
_LAST = (1 << 63) - 1
_KNOWN = 1 << 20  # words whose hash a task remembers
_PIECE = 1 << 16  # words of a text that are held at once
_HELD = 1 << 22  # features that a task holds before it passes them on
_NONE, _END = -_LAST - 1, (_LAST, _LAST)  # before every doc_id; behind every document


class Hashed:
    """Buckets of a text's features."""

    def __init__(self, max_words: int, buckets: int):
        self.max_words, self.buckets, self.known = max_words, buckets, {}

    def _words(self, words: list[bytes]) -> list[int]:
        known, crc = self.known, zlib.crc32
        if len(known) > _KNOWN:
            known.clear()
        return [known.get(w) or known.setdefault(w, crc(w)) for w in words]

    def __call__(self, text: str) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of every feature."""
        found = _WORD.finditer(text.encode("utf-8", "surrogatepass").lower())  # bytes: A-Z only
        parts, n_words, before = [], 0, []
        while words := [m[0] for _, m in zip(range(_PIECE), found)]:  # noqa: B905
            n_words += len(words)
            parts.append(np.array(self._words(words), dtype=np.uint32) % self.buckets)
            if self.max_words > 1:
                longer = []
                for w in words:  # a run's hash goes on from that of the run without its last word
                    runs = [zlib.crc32(b" " + w, c) for c in before]
                    before = [zlib.crc32(w), *runs][: self.max_words - 1]
                    longer += runs
                parts.append(np.array(longer, dtype=np.uint32) % self.buckets)
        return n_words, np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


_BAGS = "row long, doc_id long, n_words long, n_features long, bag binary"


def _bags(max_words: int, buckets: int):
    names = [c.split()[0] for c in _BAGS.split(", ")]

    def out(kept: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept, strict=True), [pa.int64()] * 4 + [pa.binary()], strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, row = Hashed(max_words, buckets), TaskContext.get().partitionId() << 40
        for batch in batches:
            kept, held = [], 0
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                n_words, found = hashed(text.as_py())
                row, held = row + 1, held + len(found)
                kept.append((row, doc_id.as_py(), n_words, len(found), found.astype(_kind(buckets)).tobytes()))
                if held >= _HELD:
                    yield out(kept)
                    kept, held = [], 0
            if kept:
                yield out(kept)

    return run


def feature_bags(texts: DataFrame, max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """row, doc_id, n_words, n_features and bag (the features' buckets) of columns doc_id and text."""
    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(_bags(max_words, buckets), _BAGS)


def bucket_counts(bags: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all texts each bucket has: an array of ``buckets`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for bag in batch.column("bag"):
                total += np.bincount(np.frombuffer(bag.as_buffer(), _kind(buckets)), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in bags.select("bag").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket 1000 x the logarithm of its share among the target's features against that among the
    documents', each count one higher, rounded down."""
    most = len(documents)
    s_all, t_all = float(documents.sum() + most), float(target.sum() + most)
    return np.array([math.floor(1000 * math.log((float(t + 1) * s_all) / (float(s + 1) * t_all))) for s, t in zip(documents.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gain: np.ndarray, seed: int):
    kind = _kind(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights, scores = [], []
            for doc_id, bag in zip(batch.column("doc_id"), batch.column("bag"), strict=True):
                own = np.frombuffer(bag.as_buffer(), kind)
                weights.append(int(gain[own].sum()) // len(own) if len(own) else 0)
                scores.append(weights[-1] + gumbel(doc_id.as_py(), seed))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "doc_id", "n_words", "n_features")], pa.array(weights, pa.int64()), pa.array(scores, pa.int64())], ["row", "doc_id", "n_words", "n_features", "weight", "score"])

    return run


def _cuts(eligible: DataFrame, percent: int, range_size: int) -> tuple[int, list[tuple[int, int]]]:
    """The number to draw, and the edges (-score, doc_id) of ranges that hold all who can be drawn."""
    counts = sorted((-s, n) for s, n in eligible.groupBy("score").count().collect())  # one row per different score
    draw = percent * sum(n for _, n in counts) // 100
    before, held, edges, crowded, end = 0, range_size, [], [], _END
    for key, n in counts:
        if before >= draw:
            end = (key, _NONE)
            break
        if held + n > range_size:
            edges.append((key, _NONE))
            held = 0
        if n > range_size:
            crowded.append((key, n))
        held, before = held + n, before + n
    if crowded:  # by doc_id, into about equal parts
        parts = max(-(-n // range_size) for _, n in crowded)
        at = F.percentile_approx(F.coalesce("doc_id", F.lit(_LAST)), [i / parts for i in range(1, parts)], 100 * parts)
        found = eligible.filter(F.col("score").isin([-k for k, _ in crowded])).groupBy("score").agg(at.alias("ids")).collect()
        edges = sorted({*edges, *((-r.score, i) for r in found for i in r.ids)})
    return draw, [*edges, end]


def _slices(edges: list[tuple[int, int]], run_size: int):
    """A partition's sorted runs, cut at the edges; what lies behind the last isn't kept."""

    def cut(parts: list[np.ndarray], number: int) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(parts, axis=1)
        rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
        at = [bisect_left(range(rows.shape[1]), e, key=lambda i: (rows[0, i], rows[1, i])) for e in edges]
        for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            if a < b:
                columns = [pa.array([np.ascontiguousarray(c[a:b]).tobytes()]) for c in rows]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([number]), pa.array([b - a]), *columns], ["part", "run", "n", "keys", "ids", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held.append(np.array([-batch.column("score").to_numpy(), batch.column("id").to_numpy(), batch.column("row").to_numpy()]))
            n += batch.num_rows
            if n >= run_size:
                yield from cut(held, number)
                held, n, number = [], 0, number + 1
        if n:
            yield from cut(held, number)

    return run


class Tournament:
    """Merges sorted iterators: a tree of winners, whose leaves are the iterators' first items. After
    each item only the matches on the way from its leaf to the root are played again."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.heads = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.tree = [0] * self.size + list(range(self.size))
        for at in range(self.size - 1, 0, -1):
            self._play(at)

    def _play(self, at: int) -> None:
        left, right = self.tree[2 * at], self.tree[2 * at + 1]
        a, b = self.heads[left], self.heads[right]
        self.tree[at] = left if b is None or (a is not None and a <= b) else right

    def __iter__(self) -> Iterator[tuple]:
        while True:
            leaf = self.tree[1] if self.size > 1 else 0
            item = self.heads[leaf]
            if item is None:
                return
            yield item
            self.heads[leaf] = next(self.runs[leaf], None)
            at = (leaf + self.size) >> 1
            while at:
                self._play(at)
                at >>= 1


def _merged(starts: list[int], draw: int):
    def run(key: tuple, slices: pd.DataFrame) -> pd.DataFrame:
        before = starts[int(key[0])]
        runs = [zip(*(np.frombuffer(s[c], np.int64).tolist() for c in ("keys", "ids", "rows")), strict=True) for s in slices.sort_values("run").to_dict("records")]
        rows = [row for (_, _, row), _ in zip(Tournament(runs), range(draw - before))]  # noqa: B905
        return pd.DataFrame({"row": np.array(rows, dtype=np.int64), "rank": np.arange(before + 1, before + 1 + len(rows), dtype=np.int64)})

    return run


def draw_ranked(scored: DataFrame, percent: int = PERCENT, run_size: int = RUN, range_size: int = RANGE) -> DataFrame:
    """row and rank of the drawn documents. ``scored``: row, doc_id and score of those that are eligible."""
    draw, edges = _cuts(scored, percent, range_size)
    rows = scored.select("score", F.coalesce("doc_id", F.lit(_LAST)).alias("id"), "row")
    slices = stash(rows.mapInArrow(_slices(edges, run_size), "part int, run long, n long, keys binary, ids binary, rows binary"), "slices")
    counts = dict(slices.groupBy("part").agg(F.sum("n")).collect())  # one row per range
    starts = [0, *accumulate(counts.get(part, 0) for part in range(len(edges) - 1))]
    wanted = slices.filter(F.col("part") < sum(s < draw for s in starts[:-1]))
    return wanted.groupBy("part").applyInPandas(_merged(starts, draw), "row long, rank long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, max_words: int = MAX_WORDS,
    buckets: int = BUCKETS, seed: int = SEED, run_size: int = RUN, range_size: int = RANGE,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every row of ``docs``.
    ``docs``: doc_id and text; ``target``: text."""
    bags = stash(feature_bags(docs, max_words, buckets), "bags")
    wanted = feature_bags(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), max_words, buckets)
    gain = gains(bucket_counts(bags, buckets), bucket_counts(wanted, buckets))
    scored = bags.mapInArrow(_scored(gain, seed), "row long, doc_id long, n_words long, n_features long, weight long, score long")
    scored = stash(scored, "scored")
    ranks = draw_ranked(scored.filter(F.col("n_words") >= least_words), percent, run_size, range_size)
    return scored.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
