"""Articles in several wrapped sections are kept whole."""

from __future__ import annotations

import pytest

from skyquad.llm import html_text


@pytest.mark.parametrize("around", ["<div>{}</div>", "<article><div class=body>{}</div></article>", "{}"])
@pytest.mark.parametrize(("sections", "paragraphs"), [(3, 8), (2, 6), (4, 10)])
def test_all_sections_of_an_article(around, sections, paragraphs):
    texts = [f"{s} {p} " + "some words of it " * 18 + "end" for s in range(sections) for p in range(paragraphs)]
    parts = ["".join(f"<p>{t}</p>" for t in texts[s * paragraphs : (s + 1) * paragraphs]) for s in range(sections)]
    page = around.format("".join(f"<section>{p}</section>" for p in parts))
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Page {i}</a></li>" for i in range(9)) + "</ul>"
    assert html_text.extract(f"<html><body>{menu}{page}</body></html>").split("\n") == texts
