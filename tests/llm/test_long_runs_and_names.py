"""Texts of a million equal characters, quotations by brute force, names of page parts, large drops."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skyquad.llm import byte_bpe, exact_dedup, html_text, packing, queries, quotes, token_binary

LONG = [" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "!" * 1_000_000, "x" + " \t\n" * 300_000 + "y", " " * 1_000_000, ("z" + " " * 255) * 2000]


def test_runs_of_a_million_characters_through_packing_and_shards(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [library.encode(t, add_special_tokens=False).ids for t in LONG]
    docs = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string").repartition(3)
    pieces = defaultdict(list)
    for p in packing.pack(docs, with_ids=True).collect():
        pieces[p.doc_id].append((p.start, np.frombuffer(bytes(p.ids), "<u4").tolist()))
    assert all([v for _, part in sorted(pieces[i]) for v in part] == [*own, 0] for i, own in enumerate(ids))
    shards = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_binary.token_shards(docs).collect()}
    assert shards == {i: (len(own) + 1, zlib.crc32(np.array([*own, 2], "<u4").tobytes())) for i, own in enumerate(ids)}


@pytest.mark.parametrize("n", [byte_bpe.LONG_SPACE + k for k in (-2, -1, 0, 1)])
def test_ids_at_the_length_from_which_the_library_takes_over(n):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * n, "a" + "\n" * n + "b", " " * n + "b", "<|endoftext|>" + "\t" * n + "é"):
        assert byte_bpe.load(byte_bpe.default_path()).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def normal(text):
    return re.sub(r"[ \t\r\n]+", " ", text.lower()).strip(" ")


def origins_by_definition(own, turn, lines):
    """The first earlier message with the passage as a paragraph, else the first with its lines in order."""
    part = " ".join(lines)
    for t in sorted(own):
        if t < turn and part in [normal(p) for p in re.split(r"\n[ \t]*\n", own[t])]:
            return t
    for t in sorted(own):
        left = iter([normal(x) for x in own[t].split("\n")])
        if t < turn and all(any(x == y for y in left) for x in lines):
            return t
    return None


@pytest.mark.parametrize("seed", range(3))
def test_quotes_by_brute_force(spark, seed):
    """Few different lines, so that most stand in many messages, in every order, and more than once."""
    rng = random.Random(seed)
    lines = ["alpha", "Beta", "gamma  delta", "eps"]
    rows, wanted = [], {}
    for conv in range(12):
        own, quoted = {}, {}
        for turn in range(14):
            quote = rng.choices(lines, k=rng.choice([0, 1, 2, 2, 3, 4]))
            text = rng.choices([*lines, ""], k=rng.randint(0, 6))
            own[turn] = ("\n" if quote else "") + "\n".join(text)
            quoted[turn] = [normal(q) for q in quote]
            rows.append((conv, turn, "user", "\n".join([*(f"> {q}" for q in quote), *text])))
        for turn in own:
            wanted[conv, turn] = origins_by_definition(own, turn, quoted[turn]) if quoted[turn] else None
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = quotes.link_quotes(table).collect()
    assert {(r.conv_id, r.turn): r.reply_to for r in found} == wanted
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    want = con.sql(f"SELECT {', '.join(found[0].asDict())} FROM ({queries.ORACLES['op1_quotation_linking']}) t").fetchall()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def test_every_message_is_tried_and_order_counts(spark):
    rows = [(1, 0, "alpha"), (1, 1, "beta"), (1, 2, "alpha\nbeta\nmore"), (1, 3, "> alpha\n> beta\nnew"), (2, 0, "one\ntwo\nthree"), (2, 1, "> three\n> one\nx"), (2, 2, "> one\n> three\ny")]
    found = quotes.link_quotes(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()
    links = {(r.conv_id, r.turn): r.reply_to for r in found}
    assert links[1, 3] == 2 and links[2, 1] is None and links[2, 2] == 0


PARAGRAPHS = [f"Paragraph {i} of the article has enough words in it to be told apart from menus and the like." for i in range(8)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
OTHER = [f"Words number {i} that aren't the article's, as many as a reader or an advertiser may write." for i in range(3)]
BOX = "".join(f"<p>{p}</p>" for p in OTHER)
GONE = ["id='comments-section'", "class='user-comments'", "class='c-comments__list'", "class='site-sidebar'", "class='cookie-bar'", "class='newsletter-signup'", "class='share-bar'", "class='author-bio'", "class='x related-articles'", "class='ad_slot_2'"]
STAYS = ["class='ad-hoc-analysis'", "class='related-work'", "class='has-comments'", "class='comments-open'", "class='no-sidebar'", "class='search-results-explained'", "class='post-content'", "class='notice-of-intent'", "class='free-banner-design'"]


@pytest.mark.parametrize("attribute", GONE)
@pytest.mark.parametrize("inside", [True, False])
def test_names_of_other_parts(attribute, inside):
    box = f"<div {attribute}>{BOX}</div>"
    page = f"<body><article>{BODY}{box * inside}</article>{box * (not inside)}</body>"
    assert html_text.extract(page).split("\n") == PARAGRAPHS


@pytest.mark.parametrize("attribute", STAYS)
def test_names_that_only_hold_such_a_word(attribute):
    assert html_text.extract(f"<body><article>{BODY}<div {attribute}>{BOX}</div></article></body>").split("\n") == [*PARAGRAPHS, *OTHER]


def test_a_page_of_comments_alone_has_their_text():
    assert html_text.extract(f"<body><div class='comments'>{BOX}</div></body>").split("\n") == OTHER


def test_precision_and_recall_on_pages_of_known_text():
    """Every box before, after or inside the article, in every kind of wrapper: blocks kept and blocks that should be."""
    rng, kept, right, wanted = random.Random(4), 0, 0, 0
    for n in range(300):
        paragraphs = [f"{k} " + " ".join(rng.choices(["some", "plain", "words", "about", "the", "matter", "itself"], k=rng.randint(12, 60))) + "." for k in range(rng.randint(3, 12))]
        boxes = [f"<div {rng.choice(GONE)}>{''.join(f'<p>{p}</p>' for p in rng.sample(OTHER, rng.randint(1, 3)))}</div>" for _ in range(3)]
        parts = [f"<p>{p}</p>" for p in paragraphs]
        parts.insert(rng.randint(0, len(parts)), boxes[0])
        article = rng.choice(["<article>{}</article>", "<div class='post-content'>{}</div>", "<main><div>{}</div></main>", "<article class='has-comments'><div>{}</div></article>", "<div id='page-{}'>".replace("{}", str(n)) + "{}</div>"]).format("".join(parts))
        menu = "<ul>" + "".join(f"<li><a href=/{i}>Page {i}</a></li>" for i in range(9)) + "</ul>"
        found = html_text.extract(f"<body><nav>{menu}</nav>{boxes[1]}{article}{menu}{boxes[2]}<footer>Imprint</footer></body>").split("\n")
        kept, right, wanted = kept + len(found), right + len(set(found) & set(paragraphs)), wanted + len(paragraphs)
    assert right / kept >= 0.99 and right / wanted >= 0.99


def test_drops_too_large_for_a_broadcast(spark):
    """The side on which texts are shuffled, once."""
    rows = [(i, f"text number {i % 700}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = exact_dedup.drop_exact_duplicates(docs)
        assert "Broadcast" not in kept._jdf.queryExecution().toString()
        assert sorted(map(tuple, kept.collect())) == sorted((max(i for i, t in rows if t == u), u) for u in {t for _, t in rows})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
