"""Spelling variants by a symmetric-delete join.

Every word of the vocabulary emits a key for itself and for each of its distinct single deletions; words
that share a key are joined, their distance is verified to be exactly one, and each word takes the
most frequent of its near words as its form, if that is ``FACTOR`` times as frequent or more. Roots
follow the forms by pointer doubling: a form is more frequent than its word, so chains are short.

Keys are 124-bit polynomial hashes, which give all deletions of a word in linear time, so that words
of any length keep their keys bounded by their length. What is shuffled are keys and word numbers, not
words. Two words of equal length that share a deletion are at distance one only if they differ at one
place; the places of the deleted characters tell most others apart before any word is read. The
words that share a key are bounded by the alphabet times their length, however frequent they are.

The vocabulary is counted in the tasks first, so no word is shuffled more often than once per task
and million different words.

Rules: words are runs of ``A-Z``, ``a-z`` and U+00C0 to U+00FF, of which only A-Z are lower-cased. One
in ``TYPO_ONE_IN`` different runs of a document, chosen by a hash, loses one character: a planted typing
error, which stands for those that a corpus has. A null text has no words; a null doc_id is hashed as
an empty one. Rows that repeat a doc_id or a text count as often as they stand there. Ties between
forms go to the first in code-point order. An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, whole_text

LEAST_CHARS = 5
LEAST_COUNT = 3
FACTOR = 2
TYPO_ONE_IN = 97
_RUN = re.compile("[a-zÀ-ÿ]+")  # over the lower-cased text
_HELD = 1 << 20  # different words that a task holds before it passes them on
_LETTERS = 1 << 21  # letters whose keys are computed at once, unless one word has more
_PRIMES = np.array([[2147483647], [2147483629], [2147483587], [2147483579]], dtype=np.uint64)
_BASES = (911382323, 972663749, 1500450271, 1820159197)


def runs_of(text: str) -> Counter:
    """The words of a text, A-Z lower-cased, with their numbers."""
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return Counter(m[0] for m in _RUN.finditer(lower))


def with_typo(run: str, start: int, one_in: int) -> str:
    """``start``: the CRC of what stands before the run."""
    h = zlib.crc32(run.encode(), start)
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(one_in: int, least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in runs_of(text.as_py()).items():
                    if len(word) >= least_chars and len(word := with_typo(word, start, one_in)) >= least_chars:
                        total[word] += n
                if len(total) >= _HELD:
                    yield out()
                    total.clear()
        if total:
            yield out()

    return run


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, one_in: int = TYPO_ONE_IN) -> DataFrame:
    """word and n of the words that are frequent enough."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    counted = rows.mapInArrow(_counted(one_in, least_chars), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class _Powers:
    """Powers of the bases, as many as the longest word needs."""

    def __init__(self):
        self.up = np.ones((4, 1), dtype=np.uint64)
        self.back = np.array([[pow(b, -1, int(p))] for b, p in zip(_BASES, _PRIMES[:, 0], strict=True)], dtype=np.uint64)

    def to(self, n: int) -> np.ndarray:
        while self.up.shape[1] < n:
            width = self.up.shape[1]
            step = np.array([[pow(b, width, int(p))] for b, p in zip(_BASES, _PRIMES[:, 0], strict=True)], dtype=np.uint64)
            self.up = np.concatenate([self.up, self.up * step % _PRIMES], axis=1)
        return self.up


_POWERS = _Powers()
_KEYS = "k1 long, k2 long, id long, place int, last int, size int"


def deletion_keys(words: list[str]) -> tuple[np.ndarray, ...]:
    """(k1, k2, word, place, last): a key for each word (place -1) and for each of its distinct single
    deletions, with the first and last place of the equal characters of which one is deleted."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - starts[word]
    sums = np.zeros((4, len(codes) + 1), dtype=np.uint64)
    np.cumsum(codes * _POWERS.to(int(sizes.max(initial=1)))[:, place] % _PRIMES, axis=1, out=sums[:, 1:])  # below 2**63: 31 bits each
    first = np.ones(len(codes), dtype=bool)
    first[1:] = (codes[1:] != codes[:-1]) | (place[1:] == 0)
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(codes))[: len(at)] - 1
    before = sums[:, at] - sums[:, starts[word[at]]]
    behind = (sums[:, ends[word[at]]] - sums[:, at + 1]) % _PRIMES * _POWERS.back
    own = (sums[:, ends] - sums[:, starts]) % _PRIMES
    h = np.concatenate([own, (before + behind) % _PRIMES], axis=1)
    k1, k2 = (((h[i] << np.uint64(31)) | h[i + 1]).view(np.int64) for i in (0, 2))
    itself = np.full(len(words), -1)
    return k1, k2, np.concatenate([np.arange(len(words)), word[at]]), np.concatenate([itself, place[at]]), np.concatenate([itself, place[last]])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _KEYS.split(", ")]
    for batch in batches:
        ids, words = batch.column("id").to_numpy(), batch.column("word").to_pylist()
        sizes = np.array([len(w) for w in words])
        for part in np.split(np.arange(len(words)), np.flatnonzero(np.diff(np.cumsum(sizes) // _LETTERS)) + 1):
            if len(part):
                k1, k2, word, place, last = deletion_keys([words[i] for i in part])
                columns = [k1, k2, ids[part][word], place.astype(np.int32), last.astype(np.int32), (sizes[part][word] - (place >= 0)).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that is not to be broadcast. All of these tables grow with the vocabulary, and Spark
    takes them for smaller than they are: keys for as many as the words they come from, some ten times too
    few, and words for as large as their compressed files."""
    return side.hint("merge")


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of ids of words at distance one. ``words``: id and word, each word once."""
    keys = words.select("id", "word").mapInArrow(_keyed, _KEYS).repartition("k1", "k2")
    left = keys.select("k1", "k2", F.col("id").alias("a"), F.col("place").alias("i"), F.col("last").alias("x"), F.col("size").alias("m"))
    right = keys.select("k1", "k2", F.col("id").alias("b"), F.col("place").alias("j"), F.col("last").alias("y"), F.col("size").alias("n"))
    # One is the other's deletion; or both have lost a character, the one at the later place out of a
    # run of equal ones that the other one's covers: else they differ at more places than one.
    one = F.expr("a < b and m = n and ((i < 0) <> (j < 0) or (i >= 0 and j >= 0 and least(x, y) >= greatest(i, j)))")
    cuts = [F.when(F.expr("i < 0 or j < 0"), F.col(c)).otherwise(F.greatest("i", "j")).alias(c) for c in ("i", "j")]
    pairs = stash(left.join(_shuffled(right), ["k1", "k2"]).filter(one).select("a", "b", *cuts).distinct(), "pairs")
    named = pairs.join(_shuffled(words.select(F.col("id").alias("a"), F.col("word").alias("u"))), "a").join(_shuffled(words.select(F.col("id").alias("b"), F.col("word").alias("v"))), "b")
    # Exactly: without the characters at these places both are the same, in time linear in the words.
    return named.filter(_without("u", "i") == _without("v", "j")).select("a", "b").distinct()


def _without(word: str, place: str) -> Column:
    rest = F.concat(F.substring(F.col(word), F.lit(1), F.col(place)), F.substring(F.col(word), F.col(place) + 2, F.length(word)))
    return F.when(F.col(place) < 0, F.col(word)).otherwise(rest)


def _roots(forms: DataFrame) -> DataFrame:
    """id and root of the words that have a form. ``forms``: id and form."""
    state = stash(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        up = state.select(F.col("id").alias("root"), F.col("root").alias("up"))
        if state.join(_shuffled(up), "root", "left_semi").isEmpty():
            return state
        state = stash(state.join(_shuffled(up), "root", "left").select("id", F.coalesce("up", "root").alias("root")), "roots")


def spelling_variants(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, factor: int = FACTOR, one_in: int = TYPO_ONE_IN
) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of the vocabulary."""
    words = stash(vocabulary(docs, least_chars, least_count, one_in).withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = stash(near_words(words), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = both.join(_shuffled(words.select(F.col("id").alias("b"), F.col("word").alias("other"), F.col("n").alias("other_n"))), "b")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other", "b")).alias("best")
    near = met.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), best).withColumnRenamed("a", "id")
    found = words.join(_shuffled(near), "id", "left")
    enough = F.coalesce(-F.col("best.less") >= factor * F.col("n"), F.lit(False))
    found = stash(
        found.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.b")).alias("form_id"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")),
        "forms",
    )
    roots = _roots(found.filter("form_id is not null").select("id", F.col("form_id").alias("form")))
    named = roots.join(_shuffled(words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))), "root").select("id", "root_word")
    return found.join(_shuffled(named), "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
