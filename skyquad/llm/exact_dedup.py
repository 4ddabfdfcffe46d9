"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary of each partition finds the digests that may be frequent. Their groups are
counted exactly (verified), and the verified winners, at most ``counters`` rows, are broadcast, so
that rows of large groups are decided on the map side and never shuffled. All other digests use
an ordinary aggregate and join; no group among them holds more than about ``2 / counters`` of the
rows. All decisions are taken on digests. ``drop_exact_duplicates`` returns whole rows, which
are shuffled once, by their keys.

Rules: a null text counts as empty. Of equal texts, the row with the largest doc_id stays; a null
doc_id is smaller than any other. Rows that repeat both doc_id and text are one group like any
other, and exactly one of them stays. An empty table gives an empty result. Other columns of the
input are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_marked, stash, text_digest

COUNTERS = 1024


def _summaries(counters: int):
    """Misra-Gries over the batches of one partition; at most ``counters`` rows leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter = Counter()
        for batch in batches:
            kept.update(batch.column(0).to_pylist())
            if len(kept) > counters:
                cut = sorted(kept.values(), reverse=True)[counters]
                kept = Counter({d: n - cut for d, n in kept.items() if n > cut})
        if kept:
            yield pa.RecordBatch.from_pydict(
                {"digest": pa.array(list(kept), pa.binary()), "n": pa.array(list(kept.values()), pa.int64())}
            )

    return run


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Candidates: at most ``counters`` values of the column ``digest``, among them every one that
    more than 2 / (counters + 1) of the rows hold."""
    parts = digests.select("digest").mapInArrow(_summaries(counters), "digest binary, n long")
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters).select("digest")


def _winner() -> list[Column]:
    best = F.max(F.struct("doc_id", "_row"))
    return [F.count(F.lit(1)).alias("group_size"), best.alias("_best")]


def exact_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest (SHA-256 of the text), keep_id, group_size, kept."""
    rows = stash(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            text_digest().alias("digest"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "digests",
    )
    total = rows.count()
    candidates = F.broadcast(frequent_digests(rows, counters))  # at most `counters` rows
    verified = rows.join(candidates, "digest", "left_semi").groupBy("digest").agg(*_winner())
    winners = stash(verified.filter(F.col("group_size") * counters > total), "winners")
    heavy = rows.join(F.broadcast(winners), "digest")  # at most `counters` rows
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    light = light.join(light.groupBy("digest").agg(*_winner()), "digest")
    return heavy.unionByName(light).select(
        "doc_id",
        "digest",
        F.col("_best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        "_row",
    )


def drop_exact_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns they came with, whatever their names.

    Rows are found again by doc_id and digest: rows that go are taken out, and where the row that
    stays is itself repeated, its repeats are collapsed in a separate, usually absent branch.
    """
    marks = stash(exact_duplicates(docs, counters), "marks")
    own = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    repeated = marks.filter((F.col("group_size") > 1) & own).groupBy("doc_id", "digest").count().filter("count > 1")
    return drop_marked(docs, marks.filter(~own).select("doc_id", "digest"), repeated.select("doc_id", "digest"))
