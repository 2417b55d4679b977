"""HTML extraction by tag-path ratios: text and punctuation per tag path, smoothed, fused and thresholded; containers of good paths stay whole."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import text_of

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*>|[^<]+|<""", re.S)
TAIL = re.compile(r"<!--.*|<!\[CDATA\[.*|[^<]+|<", re.S)
ID = re.compile(r"\sid\s*=", re.I)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Fixed lists of HTML: elements without content, with raw text, and those that stand in a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object select noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Parts of formulas and drawings, which stand in a line of text too; unlike those of HTML they may close themselves.
FOREIGN = frozenset(
    "math semantics annotation mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot munder mover munderover mstyle mtable mtr mtd mfenced mspace mpadded mphantom "
    "svg g defs symbol use text tspan textpath desc path rect circle ellipse line polyline polygon lineargradient radialgradient stop clippath mask marker pattern filter image".split()
)
IN_LINE = INLINE | FOREIGN
END_OF = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
#: Elements, roles and names of what surrounds an article.
SIDE_TAGS = frozenset("nav header footer aside form dialog menu button fieldset".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
SIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "newsletter subscribe subscription signup sidebar sidebars widget widgets related recommended recommendations share sharing social comment comments reply replies respond discussion disqus "
    "breadcrumb breadcrumbs menu menus nav navbar navigation footer header masthead toolbar pagination pager login skip copyright".split()
)
#: Elements of running text: their names say nothing, and they belong to the container that they stand in.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd blockquote pre table caption colgroup thead tbody tfoot tr td th figure figcaption address details summary center ruby".split())
LISTS = frozenset(("ul", "ol"))
#: A cell that holds one of these is a part of the page's layout, and a container.
IN_LAYOUT = frozenset("p h1 h2 h3 h4 h5 h6 div section article main ul ol table".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
MAIN_TAGS = frozenset(("article", "main"))
MARKS = re.compile(r"[.,;:!?…。、，！？；：]")
#: Neighbours on each side whose ratios smooth a block's own.
REACH = 2
#: A path is good if its fused ratio, times its prior, is at least this share of the page's mean.
SHARE = 0.35
#: A container stays if this share of its text lies on good paths, and its kind has this share of the text of the largest kind.
GOOD, MASS = 0.5, 0.1
#: Beside a named article, a kind of containers stays if it has so many times the article's text: the name stands on teasers then.
RIVAL = 4
#: Priors of blocks inside and outside of the article that a page names (1 on other pages), and of those under a doubtful name.
INSIDE, OUTSIDE, DOUBT = 8.0, 0.125, 0.5
#: Links alone are a menu if they have fewer words than this each, or if a list has this many of them, without a mark.
MENU_WORDS, MENU_ITEMS = 3, 4
#: How a class or id speaks of an element: not at all, by a part of a name, by a whole one; OUT takes the element out whatever its names.
PLAIN, PART, WHOLE, OUT = range(4)


@dataclass
class Block:
    path: int
    parent: int
    main: bool
    around: Element | None
    element: Element | None
    parts: list = field(default_factory=list)
    linked: int = 0
    text: str = ""


@dataclass(eq=False)
class Element:
    """An element: its tag, what its names say, the number of its tag path, and the next one around it whose names say something."""

    tag: str
    side: int
    path: int
    around: Element | None
    outer: Element | None = None
    #: Whether text in it is decided on together, unless a container lies in between; whether it has an id, as parts of a text that are linked to.
    container: bool = False
    anchor: bool = False
    #: Whether it is or holds an ``article`` or ``main``; whether it or one around it takes its text out, or makes it doubtful.
    named: bool = False
    out: bool = False
    doubtful: bool = False

    def doubtful_names(self) -> bool:
        return self.side != PLAIN or bool(self.around and self.around.doubtful)


def _side(tag: str, attributes: str) -> int:
    if tag in SIDE_TAGS:
        return OUT
    if not attributes or tag in ("html", "body") or tag in IN_LINE:
        return PLAIN
    found = PLAIN
    named = tag not in TEXT_TAGS or tag in LISTS or tag == "table"
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in SIDE_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return OUT
        if named and name in ("class", "id"):
            if not SIDE_NAMES.isdisjoint(value.split()):
                found = WHOLE
            elif not SIDE_NAMES.isdisjoint(re.split(r"[^a-z0-9]+", value)):
                found = max(found, PART)
    return found


def _judge(e: Element) -> None:
    """A whole name takes an element out, unless it is or holds an article; a part of a name, or a whole one around an article, is a doubt."""
    outer = e.around
    e.out = e.side == WHOLE and not e.named or bool(outer and outer.out)
    e.doubtful = e.side == PART and not e.named or e.side == WHOLE and e.named and e.tag not in MAIN_TAGS or bool(outer and outer.doubtful)


def blocks_of(page: str) -> list[Block]:
    """Blocks of text outside page furniture, in order, with their root-to-leaf tag paths."""
    blocks: list[Block] = []
    stack: list[Element] = []
    elements: list[Element] = []  # in the order of their tags, so outer ones come first
    around: list[Element] = []  # those of the stack whose names say something
    said: list[Element] = []  # all such elements of the page, outer ones first
    open_: Counter = Counter()  # how many of each tag are open
    paths: dict[tuple[int, str], int] = {}  # (path of the parent, tag) -> number of the path; 0 is the page
    parents = [-1]
    current: Block | None = None
    side = main = links = 0
    skip_to = 0

    def close(to: int) -> None:
        nonlocal side, main, links
        for e in stack[to:]:
            side -= e.side == OUT
            main -= e.tag in MAIN_TAGS
            links -= e.tag == "a"
            open_[e.tag] -= 1
            if e.side:
                around.pop()
        del stack[to:]

    last = page.rfind(">") + 1  # no tag ends behind it
    for m in chain(TOKEN.finditer(page, 0, last), TAIL.finditer(page, last)):
        if m.start() < skip_to:
            continue
        closing, tag, attributes = m.groups() or (None, None, None)
        if tag is None:
            text = m[0]
            if text[0] == "<" and (len(text) > 1 and text[1] in "!?/"):
                if not text.startswith("<![CDATA["):
                    if text.startswith("<!--") and not text.endswith("-->"):
                        skip_to = len(page)
                    continue
                text = text[9:].removesuffix("]]>")
            if side:
                continue
            if current is None:
                if not text.strip():
                    continue
                path = stack[-1].path if stack else 0
                current = Block(path, parents[path], main > 0, around[-1] if around else None, stack[-1] if stack else None)
                blocks.append(current)
            current.parts.append(text)
            if links:
                current.linked += len(text)
            continue
        tag = tag.lower()
        if closing:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag), None) if open_[tag] else None
            if at is not None and (tag not in IN_LINE or all(e.tag in IN_LINE for e in stack[at:])):
                close(at)
            if tag not in IN_LINE:
                current = None
            continue
        if tag in RAW and not attributes.endswith("/"):
            end = END_OF[tag].search(page, m.end())
            skip_to = end.end() if end else len(page)
            continue
        if tag == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        if tag not in IN_LINE:
            current = None
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == "p"), None) if open_["p"] else None
            if at is not None and all(e.tag in IN_LINE or e.tag == "p" for e in stack[at:]):
                close(at)
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag not in IN_LINE and stack[k].tag != "p"), None)
            if at is not None and (stack[at].tag == tag or tag in ("dt", "dd") and stack[at].tag in ("dt", "dd")):
                close(at)
        if attributes.endswith("/") and tag not in IN_LINE:
            continue
        path = stack[-1].path if stack else 0
        if tag not in IN_LINE:  # inline elements have the path of what they stand in
            path = paths.setdefault((path, tag), len(parents))
            if path == len(parents):
                parents.append(stack[-1].path if stack else 0)
        own = Element(tag, _side(tag, attributes), path, around[-1] if around else None, stack[-1] if stack else None)
        own.container = tag not in TEXT_TAGS and tag not in IN_LINE
        own.anchor = own.container and bool(ID.search(attributes))
        if tag in IN_LAYOUT and stack and stack[-1].tag in ("td", "th"):
            stack[-1].container = True
        stack.append(own)
        elements.append(own)
        open_[tag] += 1
        side += own.side == OUT
        if own.side:
            around.append(own)
            said.append(own)
        links += tag == "a"
        if tag in MAIN_TAGS:
            main += 1
            for e in reversed(stack):
                if e.named:
                    break
                e.named = True
    for e in said:
        _judge(e)
    for e in elements:  # where e is no container, its own one
        e.outer = e.outer if e.outer is None or e.outer.container else e.outer.outer
    for b in blocks:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    return [b for b in blocks if b.text and not (b.around and b.around.out)]


def container_of(b: Block) -> Element | None:
    e = b.element
    return e if e is None or e.container else e.outer


def fused_ratios(blocks: list[Block]) -> list[float]:
    """For each block the mean text and marks of its tag path, links left out, smoothed along its neighbours and fused."""
    totals: dict[int, list[int]] = {}
    for b in blocks:
        t = totals.setdefault(b.path, [0, 0, 0])
        t[0] += len(b.text) * (0 if _only_links(b) else 1)
        t[1] += len(MARKS.findall(b.text)) * (0 if _only_links(b) else 1)
        t[2] += 1
    text_ratio = [totals[b.path][0] / totals[b.path][2] for b in blocks]
    mark_ratio = [totals[b.path][1] / totals[b.path][2] for b in blocks]
    return [a * (1 + p) for a, p in zip(_smooth(blocks, text_ratio), _smooth(blocks, mark_ratio), strict=True)]


def good_paths(blocks: list[Block]) -> list[bool]:
    """Whether each block lies on a good path: its ratio, times its prior, against the mean of the page, or of the article that it names."""
    fused = fused_ratios(blocks)
    named = any(b.main for b in blocks)
    doubt = [DOUBT if b.around and b.around.doubtful else 1.0 for b in blocks]
    own = [x * d for b, x, d in zip(blocks, fused, doubt, strict=True) if b.main or not named]
    least = SHARE * sum(own) / len(own)
    # A doubtful block has no gain from the article that it lies in.
    prior = [d * (OUTSIDE if named and not b.main else INSIDE if named and d == 1.0 else 1.0) for b, d in zip(blocks, doubt, strict=True)]
    return [x * w >= least for x, w in zip(fused, prior, strict=True)]


def content_of(page: str | None) -> str:
    """Main text of a page: content blocks joined by line feeds; '' if there is none.

    Good paths decide on containers: one whose text lies on good paths for the most part stays whole, with its short items, cells and
    references, and one whose text does not goes whole. A container in one that stays is kept too if it has a sentence's marks or an id.
    """
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    good = good_paths(blocks)
    # Text of each container, and the part of it on good paths; text of all containers with one tag path.
    texts: dict[Element | None, list[int]] = {}
    kinds: Counter = Counter()
    for b, g in zip(blocks, good, strict=True):
        t = texts.setdefault(container_of(b), [0, 0, 0])
        t[0] += len(b.text)
        t[1] += len(b.text) * g
        t[2] += len(MARKS.findall(b.text)) * (not _only_links(b))
        kinds[_kind(container_of(b))] += len(b.text) * g
    inside = {container_of(b) for b in blocks if b.main}
    article = sum(len(b.text) for b in blocks if b.main)
    largest = max(kinds.values())
    least = {e: MASS * largest if e in inside else max(MASS * largest, RIVAL * article) for e in texts}
    stays = {e: seen[1] > 0 and seen[1] >= GOOD * seen[0] and kinds[_kind(e)] >= least[e] for e, seen in texts.items()}
    helped = {e for e, seen in texts.items() if e and not stays[e] and stays.get(e.outer) and (seen[2] or e.anchor) and not e.doubtful_names()}
    menus = _menus(blocks)
    return "\n".join(b.text for i, b in enumerate(blocks) if (stays[container_of(b)] or container_of(b) in helped) and i not in menus)


def _kind(e: Element | None) -> int:
    return -1 if e is None else e.path


def _smooth(blocks: list[Block], ratios: list[float]) -> list[float]:
    """Mean of a block's ratio and those of neighbours in the same container."""
    parents = [b.parent for b in blocks]
    out = []
    for i in range(len(ratios)):
        near = [ratios[k] for k in range(max(0, i - REACH), min(len(ratios), i + REACH + 1)) if parents[k] == parents[i]]
        out.append(sum(near) / len(near))
    return out


def _only_links(b: Block) -> bool:
    return b.linked * 10 > 8 * sum(map(len, b.parts))


def _menus(blocks: list[Block]) -> set[int]:
    """Blocks that are links alone without a mark: of a word or two, or items of a list of such links."""
    found = {i for i, b in enumerate(blocks) if _only_links(b) and not MARKS.search(b.text)}
    lists = Counter((container_of(blocks[i]), blocks[i].path) for i in found if blocks[i].text)
    every = Counter((container_of(b), b.path) for b in blocks)
    return {i for i in found if len(blocks[i].text.split()) < MENU_WORDS or lists[k := (container_of(blocks[i]), blocks[i].path)] >= MENU_ITEMS and lists[k] == every[k]}


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars``.

    Null or empty html gives an empty text. Repeated rows, equal pages and null ids stay rows of their own; extra
    columns are left out. Each page is handled alone, whole, whatever its length and nesting. An empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            out = batch[["page_id", "url"]].copy()
            out["text"] = [content_of(x) for x in batch["html"]]
            out["n_chars"] = [len(x) for x in out["text"]]
            if out["page_id"].isna().any():
                out["page_id"] = out["page_id"].astype("Int64")
            yield out

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), text_of(html_col).alias("html")).mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
