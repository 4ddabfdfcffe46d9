"""Token ids of the byte-level BPE vocabulary, as the tokenizers library gives them.

The ids come from the vocabulary in the library's .json file. Texts of ordinary Latin characters
go through a merge engine over that same vocabulary, which gives the same ids several times
faster; any other text goes through the tokenizers library itself, and so does one with a run of
``LONG_SPACE`` white-space characters or more: that engine's expression goes back over such a run
character by character, on a stack that very long ones exceed. Added tokens that occur in a text
(``<|endoftext|>``) count as their id, which is the library's default.

Texts of any length and of any characters, runs of a million equal ones among them, give the library's ids.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Characters on whose classes the two engines' Unicode tables can't differ.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa0-ɏ‐-‧‰-⁞€]")
#: Far below the length at which the merge engine's stack ends, some 700,000; its time grows with the square.
LONG_SPACE = 256
_LONG_SPACE = re.compile(rf"\s{{{LONG_SPACE}}}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = _bytes_of()
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in added}
        self.added = added
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.library = Tokenizer.from_file(path)
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text as unsigned 32-bit integers."""
        if _PLAIN.search(text) or len(text) >= LONG_SPACE and _LONG_SPACE.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if self.split and "<" in text and self.split.search(text):
            parts = [[self.added[p]] if p in self.added else self.fast.encode_ordinary(p) for p in self.split.split(text)]
            return np.array([i for p in parts for i in p], dtype=np.uint32)
        return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)
