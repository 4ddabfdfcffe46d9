"""Token ids in binary shards: Simple-8b words with per-block offsets.

Documents are tokenized and coded where they lie; their words are dealt into ranges of ascending
doc_id, and each task gathers its ranges into shards of about ``SHARD_IDS`` ids, copying words without
coding them again. A shard is a binary value in the format of ``simple8b``: a table of documents,
the word at which each block begins, and the words. The shards are rows of a Parquet folder, written
by Spark, so that any store that Spark writes will do (s3a, hdfs, ...), and a lost or repeated task
leaves no half file. Beside each shard its range, its number there and the ids of its range before it
are stored, so that a document's first position in the corpus follows from sums by range, of which
there are only so many. Reading, each task decodes all blocks of a shard at once; one document
alone is read through the offsets of its blocks (``read_document``).

Rules: a null text counts as empty and holds just the end id. Documents come in ascending order of
doc_id, those without one first; rows that repeat a doc_id follow each other in no particular order,
and where they are very many they are spread over several ranges. Every 64-bit doc_id is kept. Texts
may be of any length and hold runs of any characters; a document is in one shard as a whole, so the bytes
of a shard are bounded by ``SHARD_IDS`` ids and the ids of one document (a value of Spark's holds
2 GB, a text of some 500 million ids). An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import byte_bpe, simple8b
from .common import new_folder, whole_text

SHARD_IDS = 1 << 20
END_ID = 2
CODED = "bucket int, doc_id long, n_tokens long, words binary, sizes binary, escapes binary"
SHARDS = "bucket int, shard int, n_docs long, n_tokens long, before long, data binary"
_RANGES = 3  # ranges of doc_id for each shuffle partition
_AT_ONCE = 256  # documents coded at once
_IN_A_FILE = 32  # shards, which a reader's batch may hold together


def deal(ids: np.ndarray, known: np.ndarray, bounds: np.ndarray, turn: int) -> np.ndarray:
    """Ranges of the ids. A doc_id that fills several ranges (its value is several bounds) is dealt to
    them in turn; ids that aren't known come first."""
    low, high = np.searchsorted(bounds, ids, side="left"), np.searchsorted(bounds, ids, side="right")
    several = high - low > 1
    dealt = np.where(several, low + 1 + (turn + np.arange(len(ids))) % np.maximum(high - low, 1), high)
    return np.where(known, dealt, 0)


def _coder(vocabulary: str, end_id: int, bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end, turn = byte_bpe.load(vocabulary), np.array([end_id], dtype=np.uint32), 0
        edges = np.array(bounds, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(at, _AT_ONCE)
                arrays = [np.concatenate([tokens.encode(t.as_py()), end]) for t in part.column("text")]
                words, sizes, escapes = zip(*simple8b.encode(arrays), strict=True)
                ids = part.column("doc_id")
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                columns = {
                    "bucket": pa.array(deal(ids.fill_null(0).to_numpy(), known, edges, turn), pa.int32()),
                    "doc_id": ids,
                    "n_tokens": pa.array([len(a) for a in arrays], pa.int64()),
                    "words": pa.array(words, pa.binary()),
                    "sizes": pa.array(sizes, pa.binary()),
                    "escapes": pa.array(escapes, pa.binary()),
                }
                turn += part.num_rows
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _gather(shard_ids: int):
    """Of rows in order of range and doc_id: one row per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        lengths: list[int] = []
        coded: list[tuple[bytes, bytes, bytes]] = []
        bucket, shard, before = -1, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, before
            n = sum(lengths)
            row = (bucket, shard, len(ids), n, before, simple8b.pack_shard(ids, lengths, coded))
            shard, before = shard + 1, before + n
            for part in (ids, lengths, coded):
                part.clear()
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in SHARDS.split(", ")])

        held = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if ids and (row[0] != bucket or held >= shard_ids):
                    yield flush()
                    held = 0
                if row[0] != bucket:
                    bucket, shard, before = row[0], 0, 0
                ids.append(row[1])
                lengths.append(row[2])
                coded.append(row[3:])
                held += row[2]
        if ids:
            yield flush()

    return run


def write_token_shards(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the ids of ``docs`` to ``folder`` in ascending doc_id order, and return the manifest."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ranges = _RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    coded = rows.mapInArrow(_coder(vocabulary or byte_bpe.default_path(), end_id, sorted(cuts or [])), CODED)
    dealt = coded.repartition("bucket").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"))
    shards = dealt.mapInArrow(_gather(shard_ids), SHARDS)
    shards.write.option("maxRecordsPerFile", _IN_A_FILE).option("compression", "uncompressed").parquet(folder)
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """bucket, shard, n_docs, n_tokens and start (ids of all shards before it) of each shard."""
    shards = spark.read.schema(SHARDS).parquet(folder)
    return shards.join(_range_starts(shards), "bucket").select("bucket", "shard", "n_docs", "n_tokens", (F.col("first") + F.col("before")).alias("start"))


def _range_starts(shards: DataFrame) -> DataFrame:
    """bucket and the ids of all ranges before it: at most as many rows as there are ranges."""
    totals = shards.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges, not the shards
    return F.broadcast(totals.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, data in zip(batch.column("start"), batch.column("data"), strict=True):
            doc_ids, lengths, values = simple8b.unpack_shard(data.as_py())
            lengths = lengths.astype(np.int64)
            ends = np.cumsum(lengths)
            values = values.astype("<u4")
            crcs = [zlib.crc32(values[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            columns = [pa.array(doc_ids, pa.int64()), start.as_py() + ends - lengths, lengths, crcs]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, decoded from the shards."""
    shards = spark.read.schema(SHARDS).parquet(folder)
    placed = shards.join(_range_starts(shards), "bucket").select((F.col("first") + F.col("before")).alias("start"), "data")
    return placed.mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(data: bytes, position: int) -> np.ndarray:
    """The ids of one document of a shard, by its position there: only its own blocks are decoded."""
    return simple8b.unpack_document(data, position).astype("<u4")


def token_shards(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    folder = new_folder(docs.sparkSession, "shards")
    write_token_shards(docs, folder, vocabulary)
    return read_token_shards(docs.sparkSession, folder)
