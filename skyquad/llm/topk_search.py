"""Exact top-k inner-product search with an impact-ordered, score-at-a-time index.

Vectors become integers, floor(1024 x). They are dealt into blocks of about ``BLOCK`` vectors, and
each block is indexed once: per dimension, its vectors in order of their component, cut into ``LEVELS``
posting segments, whose quantised impact is the component at their end. A query's score is split
into the least it can get from each dimension and a non-negative excess. Segments are processed
by descending bound of their excess, adding to one accumulator per vector. From a third of the segments
on, at every ``LOOK`` of them, the k-th best score known (of earlier blocks, or the exact one among the
leaders) is held against bounds of all vectors: first the accumulator and the largest excess left in
all dimensions, and where that proves little, now and then, only in the dimensions where the vector
has not been met. Vectors that can't reach it are proved out; when few are left, or all segments are
processed, the possible members are scored exactly.

Queries are broadcast in groups of ``QUERY_GROUP`` vectors, a bound on their number and size; each
group meets every block. A task takes its blocks one after the other and passes each query's k-th score
on to the next block, and only the best k of a task are shuffled.

Rules: vectors that are null or hold null or non-finite components, and rows without vec_id, take
no part. Missing components (shorter vectors) count as 0. Every row is a candidate, also where a vec_id
repeats; rows of the query's own vec_id are not. Where a query's vec_id repeats, all its rows ask and
the best of all their answers are its answer. Components beyond 64 bits are held at the ends of that
range, and so are scores. Ties go to the smaller vec_id; with fewer than k candidates all are returned.
Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

BLOCK = 16_384
QUERY_GROUP = 16_384
LEVELS = 8
LOOK = 1 / 8  # share of the segments between two looks at the bounds
SCALE = 1024
_SAFE = 1 << 62  # sums below this can't overflow
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of long) of the rows that take part."""
    whole = F.coalesce(F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))
    rows = vectors.filter(F.col("vec_id").isNotNull() & whole)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def _matrix(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending, and their vectors, padded with zeros."""
    rows = rows.sort_values("vec_id", kind="stable")
    wide = max((len(v) for v in rows["v"]), default=0)
    out = np.zeros((len(rows), wide), dtype=np.int64)
    for i, v in enumerate(rows["v"]):
        out[i, : len(v)] = v
    return rows["vec_id"].to_numpy(np.int64), out


def _indexed(rows: pd.DataFrame) -> pd.DataFrame:
    ids, matrix = _matrix(rows)
    order = np.argsort(matrix, axis=0, kind="stable").astype(np.int32)
    return pd.DataFrame({"block": rows["block"].iloc[:1], "wide": matrix.shape[1], "ids": [ids.tobytes()], "matrix": [matrix.tobytes()], "postings": [order.tobytes()]})


def index_blocks(vectors: DataFrame) -> DataFrame:
    """One row per block of about ``BLOCK`` vectors: ids, vectors, and per dimension the vectors in
    order of their component."""
    count = max(1, -(-vectors.count() // BLOCK))
    # By position: neither an id nor a vector that very many rows hold makes a block larger.
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)).cast("int"))
    return dealt.groupBy("block").applyInPandas(_indexed, "block int, wide int, ids binary, matrix binary, postings binary")


class Index:
    """Impact-ordered postings of one block."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.matrix = ids, matrix
        n, d = matrix.shape
        self.levels = min(LEVELS, max(n, 1))
        order = np.argsort(matrix, axis=0, kind="stable").astype(np.int32) if order is None else order
        ranked = np.take_along_axis(matrix, order, axis=0)
        edges = np.linspace(0, n, self.levels + 1).astype(int)
        self.edges, self.members, values = edges, np.ascontiguousarray(order.T), np.ascontiguousarray(ranked.T)
        self.low, self.high = ranked[edges[:-1]].T, ranked[edges[1:] - 1].T  # (d, levels)
        # Contributions above the least one, for queries with a positive and a negative component.
        self.excess = (values - self.low[:, :1], self.high[:, -1:] - values)
        level = np.empty((n, d), dtype=np.uint8)
        np.put_along_axis(level, order, np.repeat(np.arange(self.levels, dtype=np.uint8), np.diff(edges))[:, None], axis=0)
        self.level = np.ascontiguousarray(level.T)
        self.size = np.abs(matrix.astype(np.float64)).max(axis=1, initial=0.0)
        self.largest = float(self.size.max(initial=0.0))

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, the vectors with id ``own`` left out; those below ``floor`` may be."""
        n, d = self.matrix.shape
        query = np.pad(query, (0, max(0, d - len(query))))[:d]
        out = slice(*np.searchsorted(self.ids, [own, own + 1] if own < _MOST else [own, own]))
        if own == _MOST:
            out = slice(out.start, n)
        live = np.ones(n, dtype=bool)
        live[out] = False
        if max(self.largest, 1.0) * float(np.abs(query.astype(np.float64)).max(initial=0.0)) * 2 * max(d, 1) >= _SAFE:
            return self._wide(query, np.flatnonzero(live), k)
        if np.count_nonzero(live) <= 4 * k:
            return self._exact(query, np.flatnonzero(live), k)
        rising = query >= 0
        size = np.abs(query)
        least = np.where(rising, self.low[:, 0], self.high[:, -1])  # component with the least contribution
        bound = np.where(rising[:, None], self.high - least[:, None], least[:, None] - self.low) * size[:, None]
        base = int(least @ query)
        if floor is not None and base + int(bound.max(axis=1, initial=0).sum()) < floor:
            return self.ids[:0], np.zeros(0, dtype=np.int64)
        order = np.argsort(-bound, axis=None, kind="stable")
        met = np.zeros(n, dtype=np.int64)
        every = max(1, int(LOOK * len(order)))
        left = bound.copy()  # bounds of segments not processed
        flat = left.reshape(-1)
        edges, levels = self.edges, self.levels
        excess = [self.excess[0 if up else 1][j] for j, up in enumerate(rising.tolist())]
        for step, segment in enumerate(order.tolist()):
            if step % every == 0 and 3 * step >= len(order):
                goal = self._goal(query, met, live, k, floor) - base
                live &= met >= goal - int(left.max(axis=1).sum())
                if step // every % 4 == 0 and np.count_nonzero(live) * 8 > n:
                    rest = np.where(left > 0, left.max(axis=1, keepdims=True), 0)
                    upper = met.copy()
                    for j in np.flatnonzero(rest.any(axis=1)).tolist():
                        upper += rest[j].take(self.level[j])
                    live &= upper >= goal
                if np.count_nonzero(live) * 8 <= n:
                    return self._exact(query, np.flatnonzero(live), k)
            if not flat[segment]:
                break  # no excess is left anywhere: the accumulators are exact
            j, level = divmod(segment, levels)
            a, b = edges[level], edges[level + 1]
            met[self.members[j, a:b]] += excess[j][a:b] * size[j]
            flat[segment] = 0
        goal = self._goal(query, met, live, k, floor) - base
        return self._exact(query, np.flatnonzero(live & (met >= goal)), k)

    def _goal(self, query: np.ndarray, met: np.ndarray, live: np.ndarray, k: int, floor: int | None) -> int:
        """A score that k vectors are known to reach."""
        some = np.flatnonzero(live)
        if len(some) <= k:
            return _LEAST // 2 if floor is None else floor
        leaders = some[np.argpartition(-met[some], k)[: 2 * k]]
        goal = int(np.sort(self.matrix[leaders] @ query)[-k])
        return goal if floor is None else max(goal, floor)

    def _exact(self, query: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores = self.matrix[rows] @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]

    def _wide(self, query: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """With components so large that 64 bits don't hold every sum: whole numbers of any size."""
        scores = self.matrix[rows].astype(object) @ query.astype(object) if self.matrix.shape[1] else np.zeros(len(rows), dtype=object)
        scores = np.array([min(max(int(s), _LEAST), _MOST) for s in scores], dtype=np.int64)
        best = np.lexsort((self.ids[rows], ~scores))[:k]  # ~ turns the order round without overflow
        return self.ids[rows][best], scores[best]


def _search(queries, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked_ids, asked = queries.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked_ids)
        for blocks in batches:
            for block in blocks.itertuples():
                ids = np.frombuffer(block.ids, np.int64)
                shape = (len(ids), block.wide)
                index = Index(ids, np.frombuffer(block.matrix, np.int64).reshape(shape), np.frombuffer(block.postings, np.int32).reshape(shape))
                for i, own in enumerate(asked_ids.tolist()):
                    known, scores = best[i]
                    found, values = index.search(asked[i], own, k, int(scores[-1]) if len(scores) == k else None)
                    known, scores = np.concatenate([known, found]), np.concatenate([scores, values])
                    first = np.lexsort((known, ~scores))[:k]
                    best[i] = known[first], scores[first]
        for at in range(0, len(asked_ids), 1024):
            part = best[at : at + 1024]
            yield pd.DataFrame(
                {
                    "query_id": np.repeat(asked_ids[at : at + 1024], [len(i) for i, _ in part]),
                    "vec_id": np.concatenate([i for i, _ in part]),
                    "score": np.concatenate([s for _, s in part]),
                }
            )

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score. ``vectors`` and ``queries``: vec_id and embedding."""
    spark = vectors.sparkSession
    index = stash(index_blocks(integer_vectors(vectors)), "postings")
    asked = stash(integer_vectors(queries), "queries")
    groups = max(1, -(-asked.count() // QUERY_GROUP))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).cast("int"))
    n_blocks = index.count()
    tasks = min(n_blocks, max(1, 4 * spark.sparkContext.defaultParallelism))
    # A block is some 13 MB; a task reads its blocks one by one.
    dealt = index.repartition(max(1, tasks))
    parts = []
    for group in range(groups):  # QUERY_GROUP queries at a time
        held = spark.sparkContext.broadcast(_matrix(asked.filter(F.col("group") == group).select("vec_id", "v").toPandas()))
        parts.append(dealt.mapInPandas(_search(held, k), "query_id long, vec_id long, score long"))
    best = parts[0]
    for part in parts[1:]:
        best = best.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
