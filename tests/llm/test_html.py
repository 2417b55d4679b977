"""HTML extraction against a plain version over trees, and cases of containers."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphlake.llm import html_text

WORDS = ["tree", "Milk,", "go.", "house", "a", "longer-word", "why?", "and"]


def page_of(draw):
    """A random well-formed page as a tree: (tag, attributes, children), children being texts or trees."""

    def words(n):
        return " ".join(draw.choice(WORDS) for _ in range(n))

    def run():
        parts = [words(draw.choice([1, 1, 2, 5, 30]))]
        if draw.random() < 0.3:
            parts = [("a", "", [words(draw.randint(1, 4))])] + ([" " + words(3)] if draw.random() < 0.3 else [])
        return parts

    def leaf():
        kind = draw.choice(["p", "p", "p", "h2", "ul", "table", "blockquote"])
        if kind == "ul":
            return ("ul", "", [("li", "", run()) for _ in range(draw.randint(1, 5))])
        if kind == "table":
            return ("table", "", [("tr", "", [("td", "", run()) for _ in range(2)])])
        return (kind, draw.choice(["", " class='share'"]) if kind == "p" else "", run())

    def box(depth):
        inner = [box(depth + 1) if depth < 3 and draw.random() < 0.35 else leaf() for _ in range(draw.randint(1, 4))]
        return (draw.choice(["div", "section", "article"] if depth == 1 else ["div", "section"]), draw.choice(["", "", " id='x'", " class='menu'", " class='top-menu'"]), inner)

    return ("body", "", [box(1) for _ in range(draw.randint(1, 4))])


def source(node):
    if isinstance(node, str):
        return node
    tag, attributes, children = node
    return f"<{tag}{attributes}>" + "".join(map(source, children)) + f"</{tag}>"


def plain(tree):
    """The text by direct definition: each block looks at all others."""
    blocks = []

    def walk(node, path, boxes):
        tag, attributes, children = node
        path = (*path, tag)
        if tag in ("body", "div", "section", "article"):
            boxes = (*boxes, (len(walked), path, attributes))
            walked.append(node)
        if tag in ("p", "h2", "li", "td", "blockquote"):
            flat = [(c, False) if isinstance(c, str) else (c[2][0], True) for c in children]
            text = " ".join("".join(t for t, _ in flat).split())
            blocks.append({"text": text, "linked": sum(len(t) for t, link in flat if link) * 10 > 8 * sum(len(t) for t, _ in flat), "path": path, "boxes": boxes})
            return
        for c in children:
            walk(c, path, boxes)

    walked = []
    walk(tree, (), ())

    def out(b):
        return any("class='menu'" in box[2] and not holds(box) for box in b["boxes"])

    def holds(box):
        """Whether a box is or holds an article."""
        return box[1][-1] == "article" or any(node_has(c) for c in walked[box[0]][2])

    def node_has(node):
        return not isinstance(node, str) and (node[0] == "article" or any(node_has(c) for c in node[2]))

    def doubtful(b):
        return any(("top-menu" in box[2] and not holds(box)) or ("class='menu'" in box[2] and holds(box) and box[1][-1] != "article") for box in b["boxes"])

    blocks = [b for b in blocks if b["text"] and not out(b)]
    if not blocks:
        return ""
    marks = lambda t: sum(c in ".,;:!?…。、，！？；：" for c in t)

    def ratio(b, measure):
        same = [x for x in blocks if x["path"] == b["path"]]
        return sum(0 if x["linked"] else measure(x["text"]) for x in same) / len(same)

    def smooth(i, measure):
        near = [ratio(blocks[k], measure) for k in range(max(0, i - 2), min(len(blocks), i + 3)) if blocks[k]["path"][:-1] == blocks[i]["path"][:-1]]
        return sum(near) / len(near)

    fused = [smooth(i, len) * (1 + smooth(i, marks)) for i in range(len(blocks))]
    main = ["article" in b["path"] for b in blocks]
    weak = [0.5 if doubtful(b) else 1.0 for b in blocks]
    own = [x * d for x, d, m in zip(fused, weak, main) if m or not any(main)]
    least = 0.35 * sum(own) / len(own)
    prior = [d * (0.125 if any(main) and not m else 8.0 if any(main) and d == 1.0 else 1.0) for d, m in zip(weak, main)]
    good = [x * p >= least for x, p in zip(fused, prior)]
    box = [b["boxes"][-1] for b in blocks]
    kind = lambda e: sum(len(b["text"]) for b, g, x in zip(blocks, good, box) if g and x[1] == e[1])
    article = sum(len(b["text"]) for b, m in zip(blocks, main) if m)

    def stays(e):
        mine = [(len(b["text"]), g, m) for b, g, m, x in zip(blocks, good, main, box) if x == e]
        if not mine:
            return False
        enough = max(0.1 * max(kind(x) for x in box), 0 if any(m for *_, m in mine) else 4 * article)
        right = sum(n for n, g, _ in mine if g)
        return right > 0 and right >= 0.5 * sum(n for n, *_ in mine) and kind(e) >= enough

    def kept(i):
        b, e = blocks[i], box[i]
        if not stays(e):
            spoken = any(marks(x["text"]) and not x["linked"] for x, y in zip(blocks, box) if y == e) or "id=" in e[2]
            named = "menu" in e[2] or any(("top-menu" in o[2] and not holds(o)) or ("class='menu'" in o[2] and holds(o) and o[1][-1] != "article") for o in b["boxes"][:-1])
            if not (len(b["boxes"]) > 1 and stays(b["boxes"][-2]) and spoken and not named):
                return False
        if b["linked"] and not marks(b["text"]):
            group = [x for x, y in zip(blocks, box) if y == e and x["path"] == b["path"]]
            return len(b["text"].split()) >= 3 and not (len(group) >= 4 and all(x["linked"] and not marks(x["text"]) for x in group))
        return True

    return "\n".join(b["text"] for i, b in enumerate(blocks) if kept(i))


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10**9))
def test_containers_are_those_of_the_plain_version(seed):
    tree = page_of(random.Random(seed))
    assert html_text.content_of(source(tree)) == plain(tree)


LONG = "".join(f"<p>Paragraph {k} of the article, long enough to be prose; it says something. It goes on, and ends here, as a long paragraph in a real article does.</p>" for k in range(8))
SHORT = (
    "<ul><li>Milk</li><li>Eggs</li><li>Flour</li><li>Salt</li><li>Oil</li></ul><table><tr><td>Cup</td><td>2</td></tr></table><dl><dt>Term</dt><dd>Meaning</dd></dl><blockquote>Eureka</blockquote>"
    "<ol><li><a href=a>Smith 2001, On trees</a><li><a href=b>Jones 1999, On leaves</a><li><a href=c>Wu 1980, Roots</a></ol><p class='share'>Shared work</p><div id='search'>Binary search</div>"
)
LEAVES = ["Milk", "Eggs", "Flour", "Salt", "Oil", "Cup", "2", "Term", "Meaning", "Eureka", "Smith 2001, On trees", "Jones 1999, On leaves", "Wu 1980, Roots", "Shared work", "Binary search"]


@pytest.mark.parametrize("tag", ["article", "main", "div"])
@pytest.mark.parametrize("count", [2, 8])
def test_short_leaves_of_an_article_stay(tag, count):
    prose = "</p>".join(LONG.split("</p>")[:count]) + "</p>"
    page = f"<body><ul><li><a href=1>Home</a></li><li><a href=2>Contact</a></li></ul><{tag}>{prose}{SHORT}</{tag}><div>All rights</div></body>"
    assert html_text.content_of(page).split("\n")[count:] == LEAVES


def test_menus_beside_and_inside_a_text_go():
    items = "".join(f"<li><a href=/{w}>{w} of the things</a></li>" for w in ("List", "Index", "Map", "Archive"))
    assert html_text.content_of(f"<div><ul>{items}</ul></div><div>{LONG}</div>").count("\n") == 7
    assert html_text.content_of(f"<div>{LONG}<ul>{items}</ul></div>").count("\n") == 7


def test_layout_cells_are_containers():
    page = f"<table><tr><td><div><a href=1>One link</a></div><ul><li>Short words</li></ul></td><td>{LONG}<p>Fine</p></td></tr></table>"
    got = html_text.content_of(page).split("\n")
    assert len(got) == 9 and got[-1] == "Fine"


def test_text_in_deep_nesting_stays():
    deep = "<div>" * 3000 + LONG + "</div>" * 3000
    assert html_text.content_of(f"<article>{deep}</article>").count("\n") == 7


@pytest.mark.parametrize("lists", [True, False])
def test_ratios_decide_without_names(monkeypatch, spark, sf_dir, lists):
    """With no list but that of forms, and then with no article named either, most pages give the same text."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    want = [html_text.content_of(p) for p in pages]
    monkeypatch.setattr(html_text, "SIDE_TAGS", frozenset(("form", "button", "fieldset")))
    monkeypatch.setattr(html_text, "SIDE_ROLES", frozenset())
    monkeypatch.setattr(html_text, "SIDE_NAMES", frozenset())
    if not lists:
        monkeypatch.setattr(html_text, "MAIN_TAGS", frozenset())
    same = sum(html_text.content_of(p) == w for p, w in zip(pages, want, strict=True))
    assert same >= (0.98 if lists else 0.75) * len(pages)
