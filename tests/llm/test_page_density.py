"""Densities and the content's root against their definition, and pages that names used to spoil."""

from __future__ import annotations

import math
import random
import time
from html.parser import HTMLParser

import pytest

from skyquad.llm import html_text


class Elements(HTMLParser):
    """Well-formed pages as nested lists [name, child, ...]."""

    def __init__(self, page):
        super().__init__()
        self.open = [["body"]]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.open[-1].append([tag])
        self.open.append(self.open[-1][-1])

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1].append(data)


def walk(node):
    yield node
    for c in node[1:]:
        if isinstance(c, list):
            yield from walk(c)


def text(node):
    return "".join(c if isinstance(c, str) else text(c) for c in node[1:])


def chars(s):
    return sum(not c.isspace() for c in s)


def link_text(node):
    if node[0] == "a":
        return chars(text(node))
    return sum(link_text(c) for c in node[1:] if isinstance(c, list))


def density(c, t, lc, lt, share):
    if not c:
        return 0.0
    base = c / max(c - lc, 1) * lc + share * c + math.e
    return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1), base)


def by_definition(root):
    """(name, density, density sum) of all elements in order."""
    share = link_text(root) / max(chars(text(root)), 1)

    def own(n):
        inner = [e for e in walk(n)][1:]
        return density(chars(text(n)), len(inner), link_text(n), sum(e[0] == "a" for e in inner), share)

    for n in walk(root):
        yield n[0], own(n), sum(own(c) for c in n[1:] if isinstance(c, list)) + density(chars("".join(c for c in n[1:] if isinstance(c, str))), 0, 0, 0, share)


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 5)):
        kind = rng.choice(["div", "section", "p", "ul", "text", "h2"] if depth < 4 else ["p", "text"])
        words = " ".join("word" * rng.randint(1, 2) for _ in range(rng.randint(1, 40)))
        if kind == "p":
            out.append(f"<p>{words} <a href=/x>{rng.choice(['link', 'a longer link'])}</a> {words}</p>" if rng.random() < 0.4 else f"<p>{words}</p>")
        elif kind == "ul":
            out.append("<ul>" + "".join(f"<li><a href=/{i}>entry {i}</a></li>" for i in range(rng.randint(1, 6))) + "</ul>")
        elif kind == "text":
            out.append(words)
        elif kind == "h2":
            out.append(f"<h2>heading {rng.randint(0, 9)}</h2>")
        else:
            out.append(f"<{kind}>{random_page(rng, depth + 1)}</{kind}>")
    return "".join(out)


@pytest.mark.parametrize("seed", range(40))
def test_densities_by_definition(seed):
    page = random_page(random.Random(seed))
    root = html_text.parse(page)
    html_text.measure(root)
    want = list(by_definition(Elements(page).open[0]))

    def nodes(n):
        yield n
        for c in n.children:
            if isinstance(c, html_text.Node):
                yield from nodes(c)

    got = [(n.name, n.density, n.sum) for n in nodes(root)]
    assert [n for n, _, _ in got] == [n for n, _, _ in want]
    for (_, a, b), (_, x, y) in zip(got, want, strict=True):
        assert a == pytest.approx(x) and b == pytest.approx(y)
    top, best, path, threshold = html_text.choose(root)
    assert max(s for _, _, s in want) == pytest.approx(max(n.sum for n in nodes(root)))
    assert best in path and top in path and threshold == min(n.density for n in path)


PARAGRAPHS = [f"Paragraph {i} of the article has enough words in it to be told apart from menus and the like." for i in range(8)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
MENU = "<ul>" + "".join(f"<li><a href=/{i}>Page {i}</a></li>" for i in range(9)) + "</ul>"


@pytest.mark.parametrize("name", ["content has-sidebar", "with-sidebar", "no-sidebar", "widget-free", "social-enabled", "l-search-results", "promo-free", "sidebar", "banner"])
@pytest.mark.parametrize("element", ["div", "section", "article"])
def test_names_of_what_holds_the_article_cut_nothing(element, name):
    page = f"<body>{MENU}<{element} class='{name}'>{BODY}</{element}><div>Imprint</div></body>"
    assert html_text.extract(page).split("\n") == PARAGRAPHS


@pytest.mark.parametrize("around", ["<form>{}</form>", "<form id=aspnet><div>{}</div></form>", "<table><tr><td>{}</td></tr></table>", "<div><div>{}</div></div>"])
def test_pages_without_article(around):
    page = f"<body>{MENU}{around.format(BODY)}<div class=sidebar><p>About us, with a few words.</p></div><footer>Imprint</footer></body>"
    assert html_text.extract(page).split("\n") == PARAGRAPHS


def test_title_in_the_header_of_the_article_and_links_in_paragraphs():
    linked = "<p>" + "A paragraph with <a href=/x>a link</a> in it, which is a part of the article. " * 4 + "</p>"
    page = f"<body><header><a href=/>Site</a></header><article><header><h1>The title</h1></header>{BODY}{linked}<p>Short.</p><p><a href=/y>One link</a></p></article></body>"
    found = html_text.extract(page).split("\n")
    assert found[0] == "The title" and found[1:9] == PARAGRAPHS
    assert found[9].startswith("A paragraph with a link in it") and found[10:] == ["Short.", "One link"]


def test_menus_and_comments_in_the_article_go():
    comments = "<div class='comments'>" + "<p>A reader writes at length about the article, in many words and more than once.</p>" * 20 + "</div>"
    page = f"<article>{BODY}{MENU}<form><p>Subscribe now</p><input></form>{comments}</article>"
    assert html_text.extract(page).split("\n") == PARAGRAPHS


@pytest.mark.parametrize("piece", ["</x></i></div>", "<b></i>", "<span><p>", "<b \"x\" ", "<title>", "<a href='", "<!-- x", "<td><tr>", "<nav></b></i>", "<"])
def test_time_is_linear(piece):
    page = "<i><div>" + "<b>" * 5_000 + piece * 40_000 + "'"
    began = time.process_time()
    assert isinstance(html_text.extract(page), str)
    assert time.process_time() - began < 8


def test_rows_of_tables_without_end_tags():
    page = "<table>" + "".join(f"<tr><td>{p}<td>cell {i}" for i, p in enumerate(PARAGRAPHS)) + "</table>"
    assert html_text.extract(page).split("\n") == [t for i, p in enumerate(PARAGRAPHS) for t in (p, f"cell {i}")]
