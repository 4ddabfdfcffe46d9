"""Near copies by exact Jaccard similarity: the near-dedup stage of the pipeline.

A text is the set of its shingles of ``SHINGLE`` = 5 words (words as in ``simhash``; a text of fewer
words is one shingle). Texts whose sets have a Jaccard similarity of 0.8 or more are linked, and of
each group of linked rows the one with the smallest doc_id stays.

Two searches propose pairs. Bitmaps of parities, a 32nd of the sets' size, bound how many shingles
two sets can share; every pair that they leave is compared exactly.

1. SimHash. The fingerprints of the five-word shingles go through the multi-index hashing of
   ``simhash``: equal fingerprints and those at ``simhash.DISTANCE`` bits. This is cheap and finds
   the closest copies, so that most of a large group is joined before anything else is compared.
2. Prefixes, for all that fingerprints can't find: at a similarity of 0.8 about ten of 64 bits
   differ, with so wide a spread that no segments small enough to look up would meet all pairs. Put
   the shingles of all sets into one order, and two sets that similar share one of their first
   ``n // 5 + 1`` shingles. The order puts frequent shingles last, those that are repeated in a sixteenth
   of the rows; it is a bitmap of bounded size, and whatever it says changes no result, only the work.
   A shingle of more than ``CROWD`` rows is a crowd. Crowds aren't compared pair by pair: in a few rounds
   each row meets the pivot rows of one of its crowds, another crowd and more pivots from round to round, and
   joins the closest ones that are similar. At last rows of different components are compared. In crowds a
   test of parities inside the join hands on few of the pairs, and each at its first shared shingle only.

A node is a distinct text, so equal texts are never compared. Rows are told apart by doc_id and
text, not by doc_id alone: of rows that repeat a doc_id each is decided for itself.

Rules: a null text counts as empty. A row without doc_id comes after all others in the choice of
the one that stays. Rows that repeat both doc_id and text are copies of each other, and one of them
stays. Shingles are compared by XXH64, texts by SHA-256. An empty table gives an empty result. All
columns are returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import drop_marked, stash, text_digest, whole_text
from .components import components

SHINGLE = 5
SEED = 42
SAMPLED = 1 / 16  # of the rows, from which frequent shingles are learned
REPEATED = (4, 40)  # occurrences there, from which on a shingle is put last, and behind those
MOST_BITS = 1 << 28  # of a bitmap of frequent shingles
CROWD = 32
PIVOTS = (4, 16, 64)  # of a crowd, in each round
CLOSEST = 3  # pivots that a row is compared with in a round
FIRSTS = 64  # keys by which a pair tells that it has been met
SKETCH = 512  # classes of the parities that are tested inside a join
_HELD = 200_000  # shingles that a task holds before it passes them on
_NODES = "node long, doc_id long, digest binary, fp long, size int, keys array<long>, bits array<long>, sketch array<long>"


def shingle_hashes(text: str) -> np.ndarray:
    """The shingles' hashes in their order, repeats included, as unsigned 64-bit integers."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)], strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8")


def shingle_set(text: str) -> np.ndarray:
    """The distinct ones, ascending."""
    return np.unique(shingle_hashes(text))


def parities(shingles: np.ndarray, classes: int | None = None) -> np.ndarray:
    """The number of shingles in each of 64 x 2**k classes, twice as many as shingles or more, as odd
    or even: one bit each. Sets that differ in d shingles differ in at most d bits."""
    classes = classes or max(64, 1 << (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column("text"):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py()).view("<i8"))], ["key"])


def frequent_shingles(rows: DataFrame) -> list[np.ndarray]:
    """Bitmaps, one for each number in ``REPEATED``, of the shingles that a sample has that often. A
    bitmap has 16 bits for each of them, up to ``MOST_BITS`` in all: beyond that, the most frequent."""
    some = rows.filter(F.rand(7) < SAMPLED)
    counts = stash(some.select("text").mapInArrow(_keys, "key long").groupBy("key").count().filter(F.col("count") >= REPEATED[0]), "frequent")
    by_count = sorted(map(tuple, counts.groupBy(F.least("count", F.lit(4096)).alias("n")).count().collect()))  # some 4000 rows
    maps = []
    for least in REPEATED:
        known = [(n, c) for n, c in by_count if n >= least]
        while len(known) > 1 and 16 * sum(c for _, c in known) > MOST_BITS:
            known = known[1:]
        bits = min(MOST_BITS, max(64, 1 << (16 * sum(c for _, c in known)).bit_length()))
        slot = F.col("key").bitwiseAND(F.lit(bits - 1).cast("long"))
        chosen = counts.filter(F.col("count") >= (known[0][0] if known else least))
        # shiftleft(1, n) takes n modulo 64, which is the place in the word.
        mask = F.expr(f"shiftleft(1L, cast((key & {bits - 1}) % 64 as int))")
        words = chosen.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(mask).alias("mask")).toArrow()
        out = np.zeros(bits // 64, dtype=np.uint64)
        out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
        maps.append(out)
    return maps


def _frequency(shingles: np.ndarray, maps: list[np.ndarray]) -> np.ndarray:
    """How many of the bitmaps have a shingle."""
    out = np.zeros(len(shingles), dtype=np.uint8)
    for bits in maps:
        slot = shingles & np.uint64(64 * len(bits) - 1)
        out += ((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(np.uint8)
    return out


def _described(common):
    """Per row its fingerprint, the size of its set and the set's prefix in the common order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = common.value
        kept: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            nodes, ids, digests, prints, sizes, *lists = zip(*kept, strict=True)
            columns = [pa.array(nodes, pa.int64()), pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32())]
            for values in lists:
                ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype("<i4")
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).view("<i8"))))
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _NODES.split(", ")])

        for batch in batches:
            for node, doc_id, digest, text in zip(*[batch.column(c) for c in ("node", "doc_id", "digest", "text")], strict=True):
                every = shingle_hashes(text.as_py())
                own = np.unique(every)
                size, bits = len(own), parities(own)
                first = own[np.argsort(_frequency(own, maps), kind="stable")[: size // 5 + 1]]
                kept.append((node.as_py(), doc_id.as_py(), digest.as_py(), simhash.majority(every), size, first, bits, parities(own, SKETCH)))
                held += size // 5 + 1
                if held >= _HELD:
                    yield out()
                    kept, held = [], 0
        if kept:
            yield out()

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, text in zip(batch.column("node"), batch.column("text"), strict=True):
            values = pa.array([shingle_set(text.as_py()).view("<i8")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.int64()), values], ["node", "shingles"])


def _folded(bits: Column, to: Column) -> Column:
    """The parities of half as many classes, where ``bits`` has twice as many as ``to``."""
    half = F.size(to)
    halves = F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bits) > half, halves).otherwise(bits)


def _differing(x: str, y: str) -> Column:
    """Bits that differ between two arrays of parities, a bound on how many shingles do."""
    differ = F.zip_with(_folded(F.col(x), F.col(y)), _folded(F.col(y), F.col(x)), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(differ, F.lit(0), lambda total, n: total + n)


_SIZES = "5 * least(m, n) >= 4 * greatest(m, n)"  # so one has at most twice the classes of the other


def _possible(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b), with ``differing``, without those whose parities show that they differ too much."""
    for side, size, bits in (("a", "m", "x"), ("b", "n", "y")):
        pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("size").alias(size), F.col("bits").alias(bits)), side)
    pairs = pairs.filter(_SIZES).withColumn("differing", _differing("x", "y"))
    # |x & y| <= (m + n - differing) / 2, and it has to be 4 / 9 (m + n) at least.
    return pairs.filter("9 * differing <= m + n").select("a", "b", "differing")


def similar(rows: DataFrame, texts: DataFrame, pairs: DataFrame | None, tested: DataFrame | None = None) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets have a similarity of 0.8 or more. Parities, which
    are small, leave hardly more than those (``tested`` pairs have passed that already); then only the
    texts of what is left are taken, by a shuffle of the rows with their keys, as in ``drop_marked``."""
    left = [] if pairs is None else [_possible(texts, pairs).select("a", "b")]
    left += [] if tested is None else [tested]
    pairs = stash((left[0] if len(left) == 1 else left[0].unionByName(left[1])).distinct(), "candidates")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    nodes = stash(texts.select("node", "doc_id", "digest").join(nodes, "node"), "nodes")
    same = rows["doc_id"].eqNullSafe(nodes["doc_id"]) & (rows["digest"] == nodes["digest"])
    sets = rows.join(nodes.hint("merge"), same).select("node", "text").mapInArrow(_sets, "node long, shingles array<long>")
    sets = stash(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")  # rows may repeat
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    joined = joined.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    # |x & y| / |x | y| >= 4/5, in whole numbers.
    near = 9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))
    return stash(joined.filter(near).select("a", "b").distinct(), "similar")


def _close_prints(texts: DataFrame) -> DataFrame:
    """Pairs of texts that fingerprints propose: each text and the first of its own fingerprint, and
    the first ones of linked fingerprints."""
    firsts = texts.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = stash(firsts, "prints")
    links = simhash.links(firsts.select("fp"))
    named = [firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node")) for c in ("a", "b")]
    across = links.join(named[0], "a").join(named[1], "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    same = texts.join(firsts.filter("n > 1"), "fp").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return same.unionByName(across)


def _side(members: DataFrame, node: str, size: str, place: str, root: str, more: tuple[str, ...] = ()) -> DataFrame:
    return members.select("key", F.col("node").alias(node), F.col("size").alias(size), F.col("place").alias(place), F.col("root").alias(root), *more)


def _few(members: DataFrame) -> DataFrame:
    """All pairs of different components that share shingles of few rows and can be similar: what
    two sets share lies in both prefixes up to their last shared place, or after it in both. (Pairs that
    share a crowd's shingle as well are found in the crowd.)"""
    pairs = _side(members, "a", "m", "i", "p").join(_side(members, "b", "n", "j", "q"), "key").filter("p <> q and a < b").filter(_SIZES)
    pairs = pairs.groupBy("a", "b", "m", "n").agg(F.count(F.lit(1)).alias("c"), F.max("i").alias("i"), F.max("j").alias("j"))
    return pairs.filter("9 * (c + least(m - i, n - j)) >= 4 * (m + n)").select("a", "b")


def _with_parities(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows with the parities of their nodes; the sketch has a column for each word."""
    return rows.join(texts.select("node", "bits", *[F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH // 64)]), "node")


def _met(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components, a of ``first`` and b of ``second``, that share a key and can be
    similar by their parities, with ``apart``, the share of bits that differ. With a column ``firsts`` the two
    tables hold the same rows, and each pair is listed one way and at its first shared key."""
    once = "firsts" in first.columns
    sides = []
    for rows, names in ((first, ("a", "m", "p", "x", "u", "f")), (second, ("b", "n", "q", "y", "v", "g"))):
        plain = [F.col(c).alias(n) for c, n in zip(("node", "size", "root", "bits"), names, strict=False)]
        sides.append(rows.select("key", *plain, *[F.col(f"s{k}").alias(f"{names[4]}{k}") for k in range(SKETCH // 64)], *([F.col("firsts").alias(names[5])] if once else [])))
    rough = sum((F.bit_count(F.col(f"u{k}").bitwiseXOR(F.col(f"v{k}"))) for k in range(SKETCH // 64)), F.lit(0))
    total, differing = F.col("m") + F.col("n"), _differing("x", "y")
    test = F.expr("p <> q and a < b" if once else "p <> q") & F.expr(_SIZES) & (9 * rough <= total) & (9 * differing <= total)
    if once:  # no shared key that both hold among their first ones comes before this one
        test &= F.coalesce(F.array_min(F.array_intersect("f", "g")) >= F.col("key"), F.lit(True))
    return sides[0].join(sides[1], "key").filter(test).select("a", "b", (differing / total).alias("apart"))


def _crowded(texts: DataFrame, crowds: DataFrame) -> DataFrame:
    """All pairs (a, b) of different components in a crowd that can be similar by their parities."""
    held = crowds.groupBy("node").agg(F.min("size").alias("size"), F.min("root").alias("root"), F.sort_array(F.collect_list("key")).alias("every"))
    known = _with_parities(texts, held).withColumn("firsts", F.slice("every", 1, FIRSTS)).withColumn("key", F.explode("every"))
    return _met(known, known).select("a", "b")


def _pivots(texts: DataFrame, crowds: DataFrame, number: int, turn: int) -> DataFrame:
    """Each row of the crowds with the closest ones of the pivots that it meets, if any can be similar.
    It meets those of one of its crowds, that of the least hash, which similar rows mostly have in common,
    and another one in each turn: so a pair is met once, however many shingles it shares. A crowd's pivots
    are the ``number`` rows of the least hashes among those that meet there."""
    at = F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("h"), "key"))
    meeting = crowds.groupBy("node").agg(F.min("size").alias("size"), F.min("root").alias("root"), at.alias("at"))
    meeting = stash(_with_parities(texts, meeting.select("node", "size", "root", F.col("at.key").alias("key"))), "meeting")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node", F.lit(turn)), "node"))
    pivots = stash(meeting.withColumn("place", place).filter(F.col("place") <= number).drop("place"), "pivots")
    closest = F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))
    return _met(meeting, pivots).withColumn("place", closest).filter(F.col("place") <= CLOSEST).select("a", "b")


def _first(doc_id: str = "doc_id", *more: str) -> Column:
    """Orders rows by doc_id, those without one last."""
    return F.struct(F.col(doc_id).isNull().alias("none"), doc_id, *more)


def near_components(docs: DataFrame, busy: int = 4) -> DataFrame:
    """doc_id, digest (of the text), n_rows, node (of the text), root (of its component) and stays,
    for each distinct doc_id and text. Pivot rounds go on while the crowds have more than ``busy``
    pairs of rows to compare for each of their rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"), whole_text().alias("text"))
    common = spark.sparkContext.broadcast(frequent_shingles(rows))  # at most MOST_BITS each
    numbered = rows.withColumn("node", F.monotonically_increasing_id())
    described = stash(numbered.mapInArrow(_described(common), _NODES), "described")
    # One node for each distinct text: repeats are few after exact deduplication, but may be any number.
    least = described.groupBy("digest").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n"))
    repeats = described.select("digest", "node").join(least.filter("n > 1"), "digest").filter("node <> first").select("node")
    repeats = stash(repeats, "repeats")
    texts = described if repeats.isEmpty() else described.join(repeats, "node", "left_anti")
    entries = texts.select("node", F.posexplode("keys").alias("place", "key"), "size").withColumn("place", F.col("place") + 1).repartition("key")
    # Every column is read on both sides of the join, so that both use one exchange.
    many = (F.col("least") != F.col("most")) & (F.col("size") > 0) & (F.col("place") > 0)
    shared = entries.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.max("size").alias("size"), F.max("place").alias("place"))
    entries = stash(entries.join(shared.filter(many).select("key"), "key"), "shared")
    keyed = texts.select("node", "doc_id", "digest", "size", "bits", "sketch")
    pairs = _close_prints(texts.select("node", "fp"))
    roots = None
    for turn in range(len(PIVOTS) + 1):
        members = entries.withColumn("root", F.col("node"))
        if roots is not None:
            members = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        info = members.groupBy("key", "root").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("key")
        info = info.agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"), F.sum("n").alias("rows")).filter("pairs > 0")
        members = stash(members.join(info, "key"), "members")
        crowds = members.filter(F.col("rows") > CROWD)
        open_pairs, n = crowds.agg(F.sum(F.col("pairs") / F.col("rows")), F.count(F.lit(1))).first()
        last = turn == len(PIVOTS) or not n or open_pairs <= busy * n
        if last:
            few = _few(members.filter(F.col("rows") <= CROWD))
            pairs = few if pairs is None else pairs.unionByName(few)
            tested = _crowded(keyed, crowds) if n else None
        else:
            tested = _pivots(keyed, crowds, PIVOTS[turn], turn)
        found = similar(rows, keyed, pairs, tested)
        # What is joined so far stands for the pairs behind it.
        roots = components(found if roots is None else found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        if last:
            break
        pairs = None
    by_text = texts.select("digest", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = described.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n_rows")).join(by_text, "digest")
    first = named.groupBy("root").agg(F.min(_first("doc_id", "digest")).alias("first"))
    stays = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.digest") == F.col("digest"))
    return named.join(first, "root").select("doc_id", "digest", "n_rows", "node", "root", stays.alias("stays"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Of each component of ``docs`` the row with the smallest doc_id, with its columns."""
    marks = stash(near_components(docs), "near-marks")
    gone, repeated = marks.filter("not stays"), marks.filter("stays and n_rows > 1")
    return drop_marked(docs, gone.select("doc_id", "digest"), repeated.select("doc_id", "digest"))
