"""Simple-8b coding of non-negative integers into 64-bit words, and the shard format around it.

A word holds a 4-bit selector and 60 bits of payload: so many values of so many bits each. Values
that need more than 60 bits are escaped: their word has selector 0 and points into a list of full
64-bit values. Values are coded in blocks of ``BLOCK``, and a document begins a block of its own;
every block starts at a known word, so any document can be decoded alone and all blocks at once
with array operations.

Shard layout (little-endian): magic ``SQ8B``, version; counts of documents, blocks, words and
escapes; doc_id (int64), whether it has one (uint8), length (uint64), first block (uint64) and first
escape (uint64) of each document; first word of each block (uint32); escapes (uint64); words (uint64).
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 512
#: Fixed values of the format. Selector: (values in a word, bits of each); selector 0 is the escape.
LAYOUTS = {
    1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8),
    9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60),
}
_DENSEST_FIRST = sorted(LAYOUTS, key=lambda s: -LAYOUTS[s][0])
_HEAD = struct.Struct("<4sIQQQQ")
_MAGIC, _VERSION = b"SQ8B", 2
_CHUNK = 128  # blocks coded at once


def _code(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of some blocks (rows of ``values``, zero-padded), words per block, escaped values and
    the blocks they are in. The payload of an escape is left to the caller."""
    rows = len(values)
    width = max(n for n, _ in LAYOUTS.values())
    padded = np.zeros((rows, BLOCK + width), dtype=np.uint64)
    padded[:, :BLOCK] = values
    # Bit lengths; rounding above 2**53 can only make one too large, which still decodes.
    needs = np.frexp(padded.astype(np.float64))[1].astype(np.uint8)
    best = np.zeros((rows, BLOCK), dtype=np.uint8)
    for selector in reversed(_DENSEST_FIRST):  # the densest that fits is written last
        n, bits = LAYOUTS[selector]
        fits = needs <= bits
        held = fits[:, :BLOCK].copy()
        have = 1
        while have < n and held.any():  # runs of n by doubling
            step = min(have, n - have)
            fits[:, : BLOCK + width - step] &= fits[:, step:]
            held = fits[:, :BLOCK]
            have += step
        best[held] = selector
    taken = np.ones(16, dtype=np.int64)
    for selector, (n, _) in LAYOUTS.items():
        taken[selector] = n
    at = np.zeros(rows, dtype=np.int64)
    starts, owners = [], []
    alive = np.flatnonzero(at < counts)
    while len(alive):
        starts.append(at[alive].copy())
        owners.append(alive)
        at[alive] += taken[best[alive, at[alive]]]
        alive = alive[at[alive] < counts[alive]]
    owner, start = np.concatenate(owners), np.concatenate(starts)
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    chosen = best[owner, start]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector, (n, bits) in LAYOUTS.items():
        mine = np.flatnonzero(chosen == selector)
        if len(mine):
            payload = np.zeros(len(mine), dtype=np.uint64)
            for k in range(n):
                payload |= padded[owner[mine], start[mine] + k] << np.uint64(k * bits)
            words[mine] |= payload
    escaped = np.flatnonzero(chosen == 0)
    return words, np.bincount(owner, minlength=rows), padded[owner[escaped], start[escaped]], owner[escaped]


def encode(documents: list[np.ndarray]) -> list[tuple[bytes, bytes, bytes]]:
    """For each array of unsigned integers: its words, the sizes of its blocks, its escapes."""
    lengths = np.array([len(d) for d in documents], dtype=np.int64)
    blocks = -(-lengths // BLOCK)
    ends = np.cumsum(blocks)
    grid = np.zeros((int(blocks.sum()), BLOCK), dtype=np.uint64)
    counts = np.full(len(grid), BLOCK, dtype=np.int64)
    for document, last, n in zip(documents, ends.tolist(), blocks.tolist(), strict=True):
        grid[last - n : last].reshape(-1)[: len(document)] = document
        if n:
            counts[last - 1] = len(document) - (n - 1) * BLOCK
    coded = [_code(grid[i : i + _CHUNK], counts[i : i + _CHUNK]) for i in range(0, len(grid), _CHUNK)]
    none = np.zeros(0, dtype=np.uint64)
    words, sizes, raw, owners = (np.concatenate(p) for p in zip(*coded, strict=True)) if coded else (none, none, none, none)
    owners = owners + np.repeat(np.arange(len(coded)) * _CHUNK, [len(c[3]) for c in coded])
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = []
    for last, n in zip(ends.tolist(), blocks.tolist(), strict=True):
        mine = words[first[last - n] : first[last]]
        escaped = raw[(owners >= last - n) & (owners < last)] if len(raw) else none
        if len(escaped):  # words point into the document's own list
            mine = mine.copy()
            mine[mine >> np.uint64(60) == 0] = np.arange(len(escaped), dtype=np.uint64)
        out.append((mine.astype("<u8").tobytes(), sizes[last - n : last].astype("<u2").tobytes(), escaped.astype("<u8").tobytes()))
    return out


def decode(words: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, escapes: np.ndarray, n_escapes: np.ndarray) -> np.ndarray:
    """The values of documents one after the other, every block at once."""
    lengths = lengths.astype(np.int64)
    out = np.zeros(int(lengths.sum()), dtype=np.uint64)
    if not len(out):
        return out
    blocks = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(lengths)), blocks)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = (np.cumsum(lengths) - lengths)[owner] + within * BLOCK  # of each block, in the output
    until = np.minimum(begin + BLOCK, np.cumsum(lengths)[owner])
    selectors = (words >> np.uint64(60)).astype(np.uint8)
    taken = np.ones(16, dtype=np.int64)
    for selector, (n, _) in LAYOUTS.items():
        taken[selector] = n
    counts = taken[selectors]
    before = np.cumsum(counts) - counts
    sizes = sizes.astype(np.int64)
    block = np.repeat(np.arange(len(sizes)), sizes)
    start = before - before[np.cumsum(sizes) - sizes][block] + begin[block]
    end = until[block]
    payload = words & np.uint64((1 << 60) - 1)
    for selector, (n, bits) in LAYOUTS.items():
        mine = np.flatnonzero(selectors == selector)
        mask = np.uint64((1 << bits) - 1)
        for k in range(n if len(mine) else 0):
            inside = mine[start[mine] + k < end[mine]]
            out[start[inside] + k] = (payload[inside] >> np.uint64(k * bits)) & mask
    escaped = np.flatnonzero(selectors == 0)
    skip = (np.cumsum(n_escapes) - n_escapes).astype(np.int64)
    out[start[escaped]] = escapes[payload[escaped].astype(np.int64) + skip[owner[block[escaped]]]]
    return out


def pack_shard(doc_ids: list[int | None], lengths: list[int], coded: list[tuple[bytes, bytes, bytes]]) -> bytes:
    words, sizes, escapes = (b"".join(p) for p in zip(*coded, strict=True))
    sizes = np.frombuffer(sizes, "<u2").astype(np.int64)
    head = _HEAD.pack(_MAGIC, _VERSION, len(doc_ids), len(sizes), len(words) // 8, len(escapes) // 8)

    def firsts(counts: list[int], kind: str) -> np.ndarray:
        return (np.cumsum(counts, dtype=np.int64) - np.array(counts, dtype=np.int64)).astype(kind)

    table = (
        np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is not None for d in doc_ids], "u1"), np.array(lengths, "<u8"),
        firsts([len(s) // 2 for _, s, _ in coded], "<u8"), firsts([len(e) // 8 for _, _, e in coded], "<u8"), firsts(sizes, "<u4"),
    )
    return head + b"".join(t.tobytes() for t in table) + escapes + words


def _tables(data: bytes) -> list[np.ndarray]:
    """doc_ids, known, lengths, first blocks, first escapes; first words; escapes; words. Nothing is copied."""
    magic, version, docs, blocks, n_words, n_escapes = _HEAD.unpack_from(data)
    if magic != _MAGIC or version != _VERSION:
        raise ValueError(f"not a token shard of version {_VERSION}")
    at, parts = _HEAD.size, []
    for kind, n in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u8", docs), ("<u8", docs), ("<u4", blocks), ("<u8", n_escapes), ("<u8", n_words)):
        parts.append(np.frombuffer(data, kind, n, at))
        at += np.dtype(kind).itemsize * n
    return parts


def unpack_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, values) of a shard."""
    doc_ids, known, lengths, _, first_escape, first_word, escapes, words = _tables(data)
    sizes = np.diff(first_word.astype(np.int64), append=len(words))
    own = np.diff(first_escape.astype(np.int64), append=len(escapes))
    ids = [d if k else None for d, k in zip(doc_ids.tolist(), known.tolist(), strict=True)]
    return ids, lengths, decode(words, sizes, lengths, escapes, own)


def unpack_document(data: bytes, position: int) -> np.ndarray:
    """The values of one document of a shard: its blocks are found by their offsets."""
    _, _, lengths, first_block, first_escape, first_word, escapes, words = _tables(data)

    def span(firsts: np.ndarray, until: int) -> tuple[int, int]:
        return int(firsts[position]), int(firsts[position + 1]) if position + 1 < len(firsts) else until

    low, high = span(first_block, len(first_word))
    begin = int(first_word[low]) if low < high else 0
    end = int(first_word[high]) if high < len(first_word) else len(words)
    end = end if low < high else begin
    sizes = np.diff(first_word[low:high].astype(np.int64), append=end)
    own = slice(*span(first_escape, len(escapes)))
    return decode(words[begin:end], sizes, lengths[position : position + 1], escapes[own], np.array([own.stop - own.start]))
