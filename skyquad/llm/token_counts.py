"""Token counts without token ids.

Each text is pre-tokenized once. A task gathers its documents into chunks of about ``CHUNK`` distinct
pre-tokens: a chunk has a table of its pre-tokens, and each of its documents a list of places in that
table with frequencies. The tables of all chunks are dealt by pre-token, so every distinct pre-token
of the corpus is encoded once, just to count its pieces. The counts go back to their chunks, are joined
to the documents' frequencies there, and summed. Nothing is broadcast or sent to the driver, and no task
holds more than a chunk.

Pre-tokens are those of the tokenizers library: for texts that are plain Latin characters once
lower-cased they are found by an expression that gives the same ones, for all other texts by the
library's own normalizer and pre-tokenizer. Added tokens inside a text count as one token, which is
the library's default.

Rules: a null text counts as empty: no bytes, no tokens. Every row counts for itself, also where a
doc_id repeats or is null. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, whole_text

LIMIT = 2048
CHUNK = 300_000  # distinct pre-tokens after which a chunk is closed
ENTRIES = 4_000_000  # and frequencies of its documents
#: Characters whose case and classes need no Unicode table; none is changed by composition.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa0-ɏ‐-‧‰-⁞€]")
_LETTER, _NUMBER = "a-zªµºß-öø-ɏ", "0-9²³¹¼-¾"
_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PreTokens:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers

        self.library = Tokenizer.from_file(path)
        self.counter = Tokenizer.from_file(path)  # for pre-tokens, which are normalized already
        self.counter.normalizer = normalizers.Sequence([])
        self.added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    def __call__(self, text: str) -> list[str]:
        if "<|" in text and self.parts.search(text):
            return [p for part in self.parts.split(text) for p in ([part] if part in self.added else self._of(part))]
        return self._of(text)

    def _of(self, text: str) -> list[str]:
        lower = text.lower()  # may leave the plain characters: capitals of African and Azerbaijani letters
        if not _OTHER.search(lower):
            return _PLAIN.findall(lower)
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, tokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.counter.encode_batch_fast(tokens, add_special_tokens=False)]


@lru_cache(maxsize=2)
def load(path: str) -> PreTokens:
    return PreTokens(path)


_CHUNKS = "chunk long, place int, token string, doc_id long, n_bytes long, places binary, freqs binary"
_COUNTED = "doc_id long, n_bytes long, n_tokens long"


def _planes(values: np.ndarray) -> bytes:
    """Numbers under 2**32 byte by byte, lowest bytes first, without the bytes that are zero in all:
    small differences become long runs, which the shuffle's compression shortens."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    rows = np.frombuffer(planes, np.uint8, offset=1).reshape(planes[0], -1).astype(np.int64)
    return sum(row << (8 * i) for i, row in enumerate(rows))


def _chunks(path: str, chunk_size: int):
    schema = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("token", pa.string()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("places", pa.binary()), ("freqs", pa.binary())])

    def batch(n: int, chunk: int, **columns) -> pa.RecordBatch:
        columns["chunk"] = np.full(n, chunk)
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, chunk = load(path), TaskContext.get().partitionId() << 32
        table: dict[str, int] = {}
        held = 0
        for docs in batches:
            kept: list[list] = [[], [], [], []]

            def documents(kept=kept) -> pa.RecordBatch:
                out = batch(len(kept[0]), chunk, **dict(zip(("doc_id", "n_bytes", "places", "freqs"), kept, strict=True)))
                for column in kept:
                    column.clear()
                return out

            for doc_id, n_bytes, text in zip(*[docs.column(c) for c in ("doc_id", "n_bytes", "text")], strict=True):
                place = table.setdefault
                found = np.array([place(t, len(table)) for t in split(text.as_py())], dtype=np.int64)
                places, freqs = np.unique(found, return_counts=True)
                for column, value in zip(kept, (doc_id.as_py(), n_bytes.as_py(), _planes(np.diff(places, prepend=0)), _planes(freqs)), strict=True):
                    column.append(value)
                held += len(places)
                if len(table) >= chunk_size or held >= ENTRIES:
                    yield documents()
                    yield batch(len(table), chunk, place=np.arange(len(table)), token=list(table))
                    table, held, chunk = {}, 0, chunk + 1
            if kept[0]:
                yield documents()
        if table:
            yield batch(len(table), chunk, place=np.arange(len(table)), token=list(table))

    return run


def _pieces(path: str):
    """Of rows in order of their pre-token: each distinct one is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, last = load(path), (None, 0)
        for batch in batches:
            coded = batch.column("token").dictionary_encode()
            tokens = coded.dictionary.to_pylist()
            known = [last[1]] if tokens[:1] == [last[0]] else []
            counts = known + split.pieces(tokens[len(known) :])
            last = tokens[-1:] and (tokens[-1], counts[-1]) or last
            pieces = pa.array(counts, pa.int32()).take(coded.indices)
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("place"), pieces], ["chunk", "place", "pieces"])

    return run


def _sum(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a chunk and the pieces of its pre-tokens."""
    pieces = np.zeros(counts.num_rows, dtype=np.int64)
    pieces[counts.column("place").to_numpy()] = counts.column("pieces").to_numpy()
    sums = [
        int(pieces[np.cumsum(_numbers(p))] @ _numbers(f)) if len(p) > 1 else 0
        for p, f in zip(docs.column("places").to_pylist(), docs.column("freqs").to_pylist(), strict=True)
    ]
    return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": docs.column("n_bytes"), "n_tokens": pa.array(sums, pa.int64())})


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, chunk_size: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    tokenizer = tokenizer or default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(whole_text()).cast("long").alias("n_bytes"), whole_text().alias("text"))
    chunks = stash(rows.mapInArrow(_chunks(tokenizer, chunk_size), _CHUNKS), "chunks")
    words = chunks.filter("token is not null").select("chunk", "place", "token")
    words = words.repartition("token").sortWithinPartitions("token")
    pieces = words.mapInArrow(_pieces(tokenizer), "chunk long, place int, pieces int")
    bags = chunks.filter("places is not null").select("chunk", "doc_id", "n_bytes", "places", "freqs")
    counted = bags.groupBy("chunk").cogroup(pieces.groupBy("chunk")).applyInArrow(_sum, _COUNTED)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
