"""Words in the values of other attributes hide nothing; attributes that hide still do."""

from __future__ import annotations

import pytest

from skyquad.llm import html_text


@pytest.mark.parametrize("attribute", ['href="/hidden-gems"', 'title="a hidden place"', 'data-x="overflow hidden"', 'href="/p?id=search"', "href=/p?id=search", 'data-hidden="1"'])
def test_values_are_no_names(attribute):
    page = f"<article><p>Words before <b {attribute}>kept text</b> and many words after it, so that this counts.</p></article>"
    assert "kept text" in html_text.extract(page)


@pytest.mark.parametrize("attribute", ["hidden", 'HIDDEN=""', 'class="a sidebar"', "id=search", "role='navigation'", 'aria-hidden="true"', 'title="x" style="display: none"'])
def test_names_still_count(attribute):
    page = f"<article><p>Words that stay, many of them, in one paragraph.</p><div {attribute}>gone text</div></article>"
    assert "gone text" not in html_text.extract(page)
