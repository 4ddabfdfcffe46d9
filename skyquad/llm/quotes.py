"""Quotation linking for conversations, with DataFrame functions only.

A line that begins with ``>`` marks is quoted; the number of marks is its level. Runs of quoted
lines of one level are passages. A passage, lower-cased and with white space reduced, is hashed and
looked up among the paragraphs of the conversation's own (unquoted) text; the original is the earliest
earlier message with that text. Where that fails, it is the earliest earlier message whose own lines
hold all lines of the passage in their order, others between them allowed. Each different passage
is looked up once, in the messages that hold its rarest line. A message answers the latest original that it quotes at level 1, or else at any level. Following these links
gives every message a thread root and a depth, by pointer doubling. The result is in reply order:
conversation, thread, turn; an answer comes after what it answers. Its text is without quotes and
without the attribution line ("On ... wrote:") above them.

Originals are reduced to one row per passage before they are joined, and messages of equal text to
their first, so a passage or a message that is repeated very often doesn't multiply rows.

Rules: a null text counts as empty. Rows without conv_id or turn are kept, linked to nothing.
Rows that repeat a conversation's turn share one link, the latest; all are kept. A passage whose
text stands nowhere earlier is unlinked. A message that answers nothing is its own thread's root,
at depth 0. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, whole_text

_BREAK = r"\r\n|\r|\n"
_QUOTED = r"^[ \t]{0,3}>"
_MARKS = r"^[ \t]{0,3}>(?:[ \t]?>)*"
_ATTRIBUTION = r"^On .* wrote:[ \t]*$"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def _hashed(text: Column) -> list[Column]:
    """128 bits."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("passage"), text).alias("h2")]


def _own(lines: Column) -> Column:
    """The unquoted lines, without attributions that stand right above a quoted one. A quotation leaves
    an empty line, so that what is above and below it stay paragraphs of their own."""
    quoted = lambda x: F.coalesce(x.rlike(_QUOTED), F.lit(False))
    after = lambda i: quoted(F.get(lines, i + 1))
    keep = lambda x, i: F.when(quoted(x), ~after(i)).otherwise(~(x.rlike(_ATTRIBUTION) & after(i)))
    return F.array_join(F.transform(F.filter(lines, keep), lambda x: F.when(quoted(x), "").otherwise(x)), "\n")


def _paragraphs(messages: DataFrame) -> DataFrame:
    """conv_id, h1, h2, part, origin: each paragraph and the first message that has it."""
    parts = messages.select("conv_id", "turn", F.explode(F.split("own", r"\n[ \t]*\n")).alias("part"))
    parts = parts.select("conv_id", "turn", _normal(F.col("part")).alias("part")).filter("part <> ''")
    return parts.select("conv_id", *_hashed(F.col("part")), "part", "turn").groupBy("conv_id", "h1", "h2", "part").agg(F.min("turn").alias("origin"))


def _holders(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """conv_id, q1, q2, want and origin: the first message that holds the lines ``want`` (of which q1, q2
    are hashes) in their order, for all that some message holds."""
    lines = F.filter(F.transform(F.split("own", "\n"), _normal), lambda x: x != "")
    own = messages.select("conv_id", "turn", lines.alias("has"))
    own = own.groupBy("conv_id", "has").agg(F.min("turn").alias("turn")).select("conv_id", "turn", F.xxhash64("has").alias("text"), "has")
    own = stash(own.filter(F.size("has") > 0), "own-lines")
    held = stash(own.select("conv_id", "turn", "text", F.explode(F.array_distinct("has")).alias("line")).select("conv_id", "turn", "text", *_hashed(F.col("line")), "line"), "lines")
    known = held.groupBy("conv_id", "h1", "h2", "line").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"))
    each = asked.select("conv_id", "q1", "q2", "want", F.explode(F.array_distinct("want")).alias("line")).select("conv_id", "q1", "q2", "want", *_hashed(F.col("line")), "line")
    met = each.join(known, ["conv_id", "h1", "h2", "line"]).groupBy("conv_id", "q1", "q2", "want")
    rarest = F.min(F.struct("n", "h1", "h2", "line", "first")).alias("r")
    met = met.agg(F.count(F.lit(1)).alias("found"), rarest).filter(F.col("found") == F.size(F.array_distinct("want")))
    met = stash(met.select("conv_id", "q1", "q2", "want", "r.h1", "r.h2", "r.line", "r.first"), "rarest")
    one = met.filter(F.size("want") == 1).select("conv_id", "q1", "q2", "want", F.col("first").alias("origin"))
    tried = met.filter(F.size("want") > 1).drop("first").join(held, ["conv_id", "h1", "h2", "line"]).select("conv_id", "q1", "q2", "want", "turn", "text")
    # How many of the wanted lines have come in order, up to each line of the message.
    step = lambda at, x: F.when(F.get(F.col("want"), at) == x, at + 1).otherwise(at)
    several = tried.join(own, ["conv_id", "turn", "text"]).filter(F.aggregate("has", F.lit(0), step) == F.size("want"))
    return one.unionByName(several.groupBy("conv_id", "q1", "q2", "want").agg(F.min("turn").alias("origin")))


def passages(messages: DataFrame) -> DataFrame:
    """One row per quoted passage: conv_id, turn, level, first (its first line's number), origin."""
    rows = messages.filter(F.exists("lines", lambda x: x.rlike(_QUOTED))).dropDuplicates(["conv_id", "turn", "lines"])
    rows = rows.select("conv_id", "turn", F.xxhash64("lines").alias("copy"), F.posexplode("lines").alias("n", "line"))
    marks = F.regexp_extract("line", _MARKS, 0)
    quoted = rows.select("conv_id", "turn", "copy", "n", F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), _normal(F.regexp_replace("line", _MARKS, "")).alias("line"))
    quoted = quoted.filter("level > 0 and line <> ''")
    run = Window.partitionBy("conv_id", "turn", "copy", "level").orderBy("n")
    quoted = quoted.withColumn("run", F.col("n") - F.row_number().over(run))
    want = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    whole = quoted.groupBy("conv_id", "turn", "copy", "level", "run").agg(F.min("n").alias("first"), want.alias("want"))
    hashes = [F.xxhash64("want").alias("q1"), F.xxhash64(F.lit("lines"), "want").alias("q2")]
    whole = whole.select("conv_id", "turn", "level", "first", "want", *hashes, F.array_join("want", " ").alias("part"))
    whole = stash(whole.select("*", *_hashed(F.col("part"))), "passages")
    found = whole.join(_paragraphs(messages), ["conv_id", "h1", "h2", "part"]).filter("origin < turn").select("conv_id", "turn", "q1", "q2", "origin")
    found = stash(found.distinct(), "by-passage")
    left = whole.join(found, ["conv_id", "turn", "q1", "q2"], "left_anti").select("conv_id", "q1", "q2", "want").distinct()
    by_lines = stash(_holders(messages, left), "by-lines")
    out = whole.select("conv_id", "turn", "level", "first", "q1", "q2", "want").join(found, ["conv_id", "turn", "q1", "q2"], "left")
    out = out.join(by_lines.withColumnRenamed("origin", "by_lines"), ["conv_id", "q1", "q2", "want"], "left")
    earlier = F.when(F.col("by_lines") < F.col("turn"), F.col("by_lines"))
    return out.select("conv_id", "turn", "level", "first", F.coalesce("origin", earlier).alias("origin"))


def _threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, thread_root, depth of the messages that answer one."""
    state = stash(links.select("*", F.col("reply_to").alias("thread_root"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = state.select("conv_id", F.col("turn").alias("thread_root"), F.col("thread_root").alias("up"), F.col("depth").alias("more"))
        if state.join(up, ["conv_id", "thread_root"], "left_semi").isEmpty():
            return state
        joined = state.join(up, ["conv_id", "thread_root"], "left")
        step = joined.select("conv_id", "turn", "reply_to", F.coalesce("up", "thread_root").alias("thread_root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        state = stash(step, "threads")


def link_quotes(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (own), n_quotes, n_linked, reply_to, thread_root, depth: one row
    per row of ``conversations``, in reply order."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.split(whole_text(), _BREAK).alias("lines"))
    rows = rows.withColumn("own", _own(F.col("lines")))
    per_message = passages(rows.filter("conv_id is not null and turn is not null")).groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n_quotes"),
        F.count("origin").alias("n_linked"),
        F.coalesce(F.max(F.when(F.col("level") == 1, F.col("origin"))), F.max("origin")).alias("reply_to"),
    )
    per_message = stash(per_message, "links")
    threads = _threads(per_message.filter("reply_to is not null").select("conv_id", "turn", "reply_to"))
    info = per_message.select("conv_id", "turn", "n_quotes", "n_linked").join(threads, ["conv_id", "turn"], "left")
    out = rows.select("conv_id", "turn", "role", F.trim(F.regexp_replace("own", r"^\n+|\n+$", "")).alias("text")).join(info, ["conv_id", "turn"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", "turn", "role", "text", F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"),
        "reply_to", F.coalesce("thread_root", "turn").alias("thread_root"), F.coalesce("depth", zero).alias("depth"),
    ).orderBy("conv_id", "thread_root", "turn")
