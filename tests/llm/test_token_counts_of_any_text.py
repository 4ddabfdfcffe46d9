"""Token counts of random texts against the library."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyquad.llm import token_counts

CAPITALS = "ƁƆƉƊƏƐƓƔƖƗƜƝƟƦƩƮƱƲƷȺȾɄɅİKÅẞ"


def assert_like_library(text):
    split = token_counts.load(token_counts.default_path())
    assert sum(split.pieces(split(text))) == len(split.library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["AYSƏN", "OULDƏN", "Ɔdɔ", *CAPITALS, *("A" + c + "B" for c in CAPITALS)])
def test_capitals_with_small_forms_elsewhere(text):
    assert_like_library(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40) | st.text(st.sampled_from("aBcZ' 1½.-é" + CAPITALS), max_size=40) | st.text(st.characters(max_codepoint=0x2200, exclude_categories=["Cs"]), max_size=40))
def test_counts_of_any_text(text):
    assert_like_library(text)
