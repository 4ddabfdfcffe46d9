"""SentencePiece merge-type encoding by backtracking, and decoding.

White space is escaped as in the library (a leading mark, no other normalization) and a text falls
into units at places that no piece spans; units are encoded once and remembered in a bounded
table. A unit is encoded from left to right: Aho-Corasick gives the longest piece at each position;
a piece is taken if it is compatible with the one before it, which holds if merging the two
pieces' characters again gives just these two; otherwise the next shorter piece is tried, and
where none is left the position is marked in a bitfield as failed and the last piece is taken
back. Each position fails at most once, so the work is linear in the length of the unit.
Characters outside the vocabulary become byte pieces.

Rules: a null text counts as empty: no ids, an empty decoding. Rows are independent, so ties and
repeated rows are encoded alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

MARK = "▁"
REMEMBERED = 600_000  # units, or pairs of pieces, held by a Python worker
#: Piece types of the model file (fixed values of the format).
NORMAL, BYTE = 1, 6


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceBpe:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only merge-type models without normalization are supported")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.text_of = [p.piece for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.id_of = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type not in (NORMAL, BYTE)}
        self.known = {c for p in self.id_of for c in p}
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id_of), None) for p in self.id_of}
        self.matcher = ahocorasick.Automaton()
        for piece in self.id_of:
            self.matcher.add_word(piece, piece)
        self.matcher.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.units: dict[str, tuple[str, str]] = {}
        letters = "A-Za-zÀ-ɏ"
        rest = [f"{MARK}*[^{MARK}\n]+", f"{MARK}+"]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.id_of):
            raise ValueError("pieces that span words are not supported")
        if not any(re.search(f"[{letters}][.,]", p) for p in self.id_of):
            rest.insert(0, f"{MARK}*[{letters}]+(?=[.,])")
        self.split = re.compile("|".join(["\n", *rest])).findall

    def merge(self, text: str) -> list[str]:
        """Merge-type encoding by its definition: always the best pair, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merge(left + right) == [left, right]
        return found

    def pieces(self, unit: str) -> list[str]:
        """The pieces of a unit all of whose characters are in the vocabulary."""
        if unit in self.id_of and self.merge(unit) == [unit]:
            return [unit]
        size = len(unit)
        longest: list[str] = [""] * size
        for end, piece in self.matcher.iter(unit):
            start = end + 1 - len(piece)
            if len(piece) > len(longest[start]):
                longest[start] = piece
        open_ = bytearray(b"\1") * (size + 1)
        taken: list[str] = []
        at, piece = 0, longest[0]
        while True:
            last = taken[-1] if taken else None
            while piece and not (open_[at + len(piece)] and (last is None or self.compatible(last, piece))):
                piece = self.shorter[piece]
            if piece:
                taken.append(piece)
                at += len(piece)
                if at == size:
                    return taken
                piece = longest[at]
            else:
                if last is None:
                    raise ValueError(f"no encoding of {unit!r}")
                open_[at] = 0
                piece = taken.pop()
                at -= len(piece)

    def _remember(self, unit: str) -> tuple[str, str]:
        """The ids of a unit as text, each after a comma, and what they decode to."""
        ids: list[int] = []
        known = self.known
        start = 0
        for i, c in enumerate(unit):
            if c not in known:
                if i > start:
                    ids += [self.id_of[p] for p in self.pieces(unit[start:i])]
                ids += [self.byte_id[b] for b in c.encode()]
                start = i + 1
        if start < len(unit):
            ids += [self.id_of[p] for p in self.pieces(unit[start:] if start else unit)]
        if len(self.units) >= REMEMBERED:
            self.units.clear()
        said = self._text(ids)
        found = ("," + ",".join(map(str, ids)), unit if said == unit else said)
        if len(unit) <= 64:
            self.units[unit] = found
        return found

    def _text(self, ids: Iterable[int]) -> str:
        parts, held = [], b""
        for i in ids:
            if i in self.byte_of:
                held += self.byte_of[i]
                continue
            if held:
                parts.append(held.decode(errors="replace"))
                held = b""
            parts.append("" if i in self.silent else self.text_of[i])
        return "".join(parts) + held.decode(errors="replace")

    def _units(self, text: str) -> list[tuple[str, str]]:
        if not text:
            return []
        get, remember = self.units.get, self._remember
        return [get(u) or remember(u) for u in self.split(self.prefix + text.replace(" ", MARK))]

    def decode(self, ids: Iterable[int]) -> str:
        return self._text(ids).removeprefix(self.prefix).replace(MARK, " ")

    def encode(self, text: str) -> list[int]:
        return [int(i) for u in self._units(text) for i in u[0][1:].split(",")]

    def encode_and_decode(self, text: str) -> tuple[str, str]:
        """(ids as decimal numbers joined by commas, decoded text)."""
        units = self._units(text)
        said = "".join([u[1] for u in units])
        return "".join([u[0] for u in units])[1:], said.removeprefix(self.prefix).replace(MARK, " ")


@lru_cache(maxsize=2)
def load(path: str) -> PieceBpe:
    return PieceBpe(path)


def _encode(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in batches:
            counts, ids_hash, text_hash, ids = [], [], [], []
            for text in batch.column("text"):
                joined, said = coder.encode_and_decode(text.as_py())
                counts.append(joined.count(",") + 1 if joined else 0)
                ids_hash.append(hashlib.sha256(joined.encode()).hexdigest())
                text_hash.append(hashlib.sha256(said.encode()).hexdigest())
                if with_ids:
                    ids.append([int(i) for i in joined.split(",")] if joined else [])
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(ids_hash, pa.string()),
                "decoded_sha256": pa.array(text_hash, pa.string()),
            }
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))

    return run


def encode_documents(docs: DataFrame, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_encode(model or default_path(), with_ids), schema)
