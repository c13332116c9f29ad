"""Main text of web pages by tree scoring.

A page becomes a tree of elements with their blocks of text. Each paragraph-like block gives points for its length and
its commas to its parent and half of them to its grandparent and above; a container's points are cut by the share of
its text that stands in links. The main element or the outermost article around the best container is kept whole; inside a
main element, and on pages that have neither, everything else is kept but branches that are mostly links. Beside an
article, what is kept has at least a fifth of its points, or is a heading before it; another article goes if it is a
teaser, with links and less than half of the points.
Menus, headers and footers of the page, sidebars, notices, adverts, forms, comments by readers, scripts, styles and
hidden parts never count: by element, by role, or by words in class and id, unless an element so named (or a form)
holds the article. A header inside an article or main belongs to it. Time is linear in the page, however deeply
elements are nested.

White space inside a block becomes one space; blocks are joined by one space in page order. Character references are
decoded, nothing else is dropped or cut. Null and empty pages, and pages without text, give an empty text; open and
stray tags are closed as browsers do it for paragraphs, list items, cells and options; what a page cut short still holds
is read. Other columns are untouched.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import filled

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template svg math".split())
NEVER = frozenset("script style noscript iframe template svg math head title nav aside footer button label legend datalist select textarea input dialog menu object canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# What the beginning of an element closes, up to the nearest of the listed borders.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
_BORDERS = frozenset("td th table button object".split())  # a paragraph beyond these stays open
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())

# Words in class, id or role that mark what does not belong to an article.
_READERS = "comments?|commentlist|disqus|related|replies|respond"  # often longer than the article
_NOTICES = "ads?|advert\\w*|alert|alertdialog|banner\\w*|consent|cookies?|gdpr|newsletter|notices?|popup|promo\\w*|sponsor\\w*|subscribe"  # with prose of their own
_LAYOUT = (
    "breadcrumbs?|dialog|footer|login|masthead|menu|modal|nav|navbar|navigation|pager|pagination|print-only|share\\w*|sharing|sidebar|signup|skip-?link|social|toolbar|"
    "widget|complementary|contentinfo|search|hidden|sr-only"
)
_HEADERS = "header|site-?header|masthead|branding|site-?title|site-?name|tagline|topbar|top-bar"  # outside of articles only
UNLIKELY = re.compile(rf"(?:^|[-_])(?:(?P<readers>{_READERS})|(?P<notices>{_NOTICES})|(?:{_LAYOUT}))(?:$|[-_])", re.IGNORECASE)
# Names that hold such a word and say something else: no-sidebar, page-with-comments, share-enabled, search-result-page, elementor-widget-container.
_APART = re.compile(
    r"(?:^|[-_])(?:no|not|non|has|have|with|without|show|hide|enable|disable)[-_].*|^.*[-_](?:enabled|disabled|open|opened|closed|active|layout|page|template)$|^(?:elementor|wp)[-_]widget",
    re.IGNORECASE,
)
# Names of a header of the page; one that names a part of an article as well is that part's header.
HEADER = re.compile(rf"(?:^|[-_])(?:{_HEADERS})(?:$|[-_])", re.IGNORECASE)
_OF_ARTICLE = re.compile(r"(?:^|[-_])(?:article|content|entry|post|section|story)(?:$|[-_])", re.IGNORECASE)
LIKELY = re.compile(r"(?:^|[-_\s])(?:article|body|content|entry|main|page|post|story|text)(?:$|[-_\s])", re.IGNORECASE)
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
SHORT = 25  # characters under which a block gives no points


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None
    order: int
    off: bool = False
    weight: float = 0.0
    score: float = 0.0
    chars: int = 0
    linked: int = 0
    points: float = 0.0  # of all blocks inside
    counted: float = 0.0  # the same without what readers wrote
    marks: tuple[tuple[str, str], ...] = ()
    under: Node | None = None  # the element itself or the nearest around it that its name may switch off
    home: Node | None = None  # the element itself or the nearest around it that stands in a line of its own
    paragraph: Node | None = None  # the paragraph that the beginning of a block closes
    readers: bool = False  # inside what readers wrote
    open: bool = True


@dataclass(eq=False)
class Block:
    node: Node
    text: str
    linked: int
    under: Node | None = None


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def _closes_itself(raw: str) -> bool:
    """Whether a tag ends in a slash that is not part of an unquoted value."""
    return raw.endswith("/") and all(m.end() < len(raw) for m in _ATTRIBUTE.finditer(raw))


def _off(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element never belongs to an article, whatever its name."""
    return tag in NEVER or "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_HIDDEN_STYLE.search(attrs.get("style", "")))


@lru_cache(maxsize=4096)
def _marks(named: str) -> tuple[tuple[str, str], ...]:
    """The names that speak against an element, each with the kind of its word."""
    found = ((x, UNLIKELY.search(_APART.sub("", x))) for x in dict.fromkeys(named.lower().split()))
    return tuple((x, "readers" if m["readers"] else "notices" if m["notices"] else "layout") for x, m in found if m)


@lru_cache(maxsize=4096)
def _heads_page(named: str) -> bool:
    return any(x == "banner" or HEADER.search(_APART.sub("", x)) and not _OF_ARTICLE.search(x) for x in named.lower().split())


def _points(b: Block) -> float:
    size = len(b.text)
    points = 0.0 if size < SHORT else 1.0 + b.text.count(",") + b.text.count("،") + b.text.count("、") + min(size / 100, 3.0)
    return points * (0.3 if b.node.tag in ("li", "dd", "dt", "td", "th") and b.linked * 2 > size else 1.0)


def _above(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _kinds(node: Node) -> set[str]:
    return {kind for _, kind in node.marks}


def _without_named(nodes: list[Node], blocks: list[Block]) -> list[Block]:
    """The blocks outside elements that their names switch off.

    A name does not count against what holds the page's article or main, or most of the points of its paragraphs, alone
    or with all elements of that name (for notices: nine tenths; for readers' comments and related pages points do not
    count). If no block is left, names do not count at all.
    """
    if all(b.under is None for b in blocks):
        return blocks
    total = free = 0.0
    for b in blocks:
        points = _points(b)
        own = 0.0 if b.node.readers or (b.under is not None and b.under.readers) else points
        total += own
        free += 0.0 if b.under else points
        # Formatting elements between a block's home and its text may be named, too: points go to the innermost of them.
        at = b.under if b.under is not None and b.under.order > b.node.order else b.node
        at.points += points
        at.counted += own
        at.chars += len(b.text)
    for x in reversed(nodes):
        if x.parent is not None:
            x.parent.points += x.points
            x.parent.counted += x.counted
            x.parent.chars += x.chars
    held = [x for x in nodes if x.tag in ("article", "main") and "readers" not in _kinds(x) and x.chars]
    outside = max(((x.points, x.chars) for x in held if x.under is None), default=(-1.0, 0))
    # Which elements hold an article that speaks for them: for all of them, or for those that are not the readers'.
    for_all, for_most = set(), set()
    for x in held:
        if x.under is not None and (x.tag == "main" or (x.points, x.chars) > outside):
            (for_all if x.tag == "main" or x.points >= free else for_most).add(x)
    for x in reversed(nodes):
        if x.parent is not None:
            if x in for_all:
                for_all.add(x.parent)
            if x in for_most:
                for_most.add(x.parent)
    named = [x for x in nodes if x.under is x and x.chars]
    stays = {x for x in named if x in for_all or x in for_most and "readers" not in _kinds(x)}
    # What stands beside an article with paragraphs is judged by its name alone.
    real = {x for x in held if x.points and x.under is None}
    within: dict[Node, int] = {}
    for x in nodes:
        within[x] = (within[x.parent] if x.parent else 0) + (x in real)
    rest = [x for x in named if x not in stays and within[x] == len(real)]
    share = {"layout": 0.5, "notices": 0.9}
    most = lambda points, kind: kind in share and points > share[kind] * total
    stays.update(x for x in rest if all(most(x.counted, kind) for _, kind in x.marks))
    open_ = set(rest) - stays
    by_name: dict[tuple[str, str], float] = {}
    around: dict[tuple[str, str], int] = {}
    line: list[Node] = []
    for x in nodes:  # parents come before their children
        while line and line[-1] is not x.parent:
            left = line.pop()
            for m in left.marks if left in open_ else ():
                around[m] -= 1
        line.append(x)
        if x in open_:
            for m in x.marks:
                if not around.get(m):
                    by_name[m] = by_name.get(m, 0.0) + x.counted
                around[m] = around.get(m, 0) + 1
    stays.update(x for x in open_ if all(most(by_name[m], m[1]) for m in x.marks))
    good: dict[Node, bool] = {}
    for x in nodes:
        good[x] = (good[x.parent] if x.parent else True) and (x.under is not x or x in stays)
    for x in nodes:
        x.chars = 0
    return [b for b in blocks if good[b.under if b.under is not None and b.under.order > b.node.order else b.node]] or blocks


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """The elements of a page, parents before children, and the blocks that may belong to an article."""
    root = Node("html", None, 0)
    root.home = root
    nodes = [root]
    stack = [root]
    opened: dict[str, list[Node]] = {}
    blocks: list[Block] = []
    buffer: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        text = " ".join("".join(t for t, _ in buffer).split())
        if text and not stack[-1].off:
            blocks.append(Block(stack[-1].home, text, sum(len("".join(t.split())) for t, linked in buffer if linked), stack[-1].under))
        buffer.clear()

    def shut(x: Node) -> None:
        nonlocal links
        x.open = False
        opened[x.tag].remove(x) if opened[x.tag][-1] is not x else opened[x.tag].pop()
        links -= x.tag == "a"

    def leave(x: Node) -> None:
        """Close an element and all that is open inside it."""
        flush()
        while True:
            top = stack.pop()
            if top.open:
                shut(top)
            if top is x:
                return

    def close(names: set[str], borders: set[str]) -> None:
        if not any(opened.get(t) for t in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].open and stack[k].tag in names:
                leave(stack[k])
                return
            if stack[k].open and stack[k].tag in borders:
                return

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        m = _TOKEN.match(page, start) if start >= 0 else None
        text_end = n if start < 0 else start if m else start + 1
        if text_end > at and not stack[-1].off:
            buffer.append((html.unescape(page[at:text_end]), links > 0))
        if start < 0:
            break
        if not m:
            at = start + 1
            continue
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and not stack[-1].off:
                buffer.append((m[0][9:].removesuffix("]]>"), links > 0))
            continue
        if m[1]:
            found = opened.get(tag)
            if tag == "p" and not found:
                flush()
            elif found and tag in BLOCKS:
                leave(found[-1])
            elif found and (found[-1].home is stack[-1].home or tag in NEVER):
                x = found[-1]  # formatting closes alone, what it holds stays open
                if x.off or x.under is x:
                    flush()
                shut(x)
                while not stack[-1].open:
                    stack.pop()
            continue
        attrs = _attributes(m[3]) if m[3] and "=" in m[3] or "hidden" in (m[3] or "") else {}
        if tag == "br":
            buffer.append((" ", links > 0))
            continue
        if tag in BLOCKS or tag in ("option", "select"):
            flush()
            if tag != "hr" and tag in BLOCKS and stack[-1].paragraph is not None:
                leave(stack[-1].paragraph)
            if tag in CLOSES:
                close(*CLOSES[tag])
        if tag in VOID:
            continue
        if tag in ("svg", "math") and _closes_itself(m[3]):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        if m[3] and m[3].rstrip().endswith("/") and tag not in BLOCKS and tag not in ("a", "span", "b", "i", "em", "strong"):
            continue
        around = stack[-1]
        off = around.off or _off(tag, attrs)
        named = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        marks = _marks(f"{named} {attrs.get('role', '')}") if attrs else ()
        if tag == "form":
            marks += (("form", "layout"),)
        if tag in BLOCKS and tag not in _HEADINGS and not opened.get("article") and not opened.get("main"):
            marks += (("header", "layout"),) if tag == "header" or attrs and _heads_page(f"{named} {attrs.get('role', '')}") else ()
        by_name = bool(marks) and tag not in ("html", "body", "article", "main")
        if (off or by_name) and not around.off:
            flush()
        node = Node(tag, around, len(nodes), off, marks=marks)
        node.under = node if by_name else around.under
        node.home = node if tag in BLOCKS else around.home
        node.paragraph = node if tag == "p" else None if tag in _BORDERS else around.paragraph
        node.readers = around.readers or by_name and "readers" in _kinds(node)
        node.weight = (25.0 if tag in ("article", "main") else 0.0) + (15.0 if named.strip() and LIKELY.search(named) else 0.0)
        nodes.append(node)
        stack.append(node)
        opened.setdefault(tag, []).append(node)
        links += tag == "a"
    flush()
    return nodes, _without_named(nodes, blocks)


def main_text(page: str | None) -> str:
    nodes, blocks = parse(page or "")
    if not blocks:
        return ""
    for x in nodes:
        x.points = 0.0
    for b in blocks:
        b.node.chars += len(b.text)
        b.node.linked += b.linked
        points = _points(b)
        b.node.points += points
        (b.node if b.node.tag in CONTAINERS else b.node.parent or b.node).score += points
    for x in reversed(nodes):  # half of an element's score goes to the one around it
        if x.parent is not None:
            x.parent.score += x.score / 2
            x.parent.points += x.points
            x.parent.chars += x.chars
            x.parent.linked += x.linked
    value = lambda x: (x.score + (x.weight if x.score else 0.0)) * (1 - min(x.linked / max(x.chars, 1), 1.0))
    best = max((x for x in nodes if x.chars and (x.tag in CONTAINERS or x.parent is None)), key=lambda x: (value(x), -x.order))
    # The article is all of the main element or of what stands beside the outermost article, else of the page. Branches
    # that lead away from the best container's line, or from the article it lies in, go if they are mostly links.
    line = list(_above(best))
    whole = next((x for x in reversed(line) if x.tag == "article"), best)
    beside = (whole.parent or whole) if whole.tag == "article" else line[-1]
    top = next((x for x in reversed(list(_above(whole))) if x.tag == "main"), beside)
    goes_on = set(_above(whole)) - {whole}
    # Beside an article that no main element holds, only what has points of its own.
    bar = whole.points / 5 if whole.tag == "article" and top.tag != "main" else 0.0
    # Of each element: whether it lies in the article, in what is looked at, and the branch that leads to it.
    inside: dict[Node, bool] = {}
    below: dict[Node, bool] = {}
    branch: dict[Node, Node | None] = {}
    teaser: dict[Node, bool] = {}
    articles: dict[Node, bool] = {}
    for x in nodes:
        up = x.parent
        inside[x] = x is whole or up is not None and inside[up]
        below[x] = x is top or up is not None and below[up]
        branch[x] = None if inside[x] or x is top or x in goes_on else (branch[up] if up is not None and branch[up] else x)
        other = x.tag == "article" and not inside[x] and x not in goes_on and whole.tag == "article"
        teaser[x] = other and x.points < whole.points / 2 and x.linked * 10 > x.chars or up is not None and teaser[up]
        articles[x] = other or up is not None and articles[up]
    out = []
    for b in blocks:
        if inside[b.node]:
            out.append(b.text)
        elif below[b.node] and not teaser[b.node]:
            away = branch[b.node]
            part, linked, points = (away.chars, away.linked, away.points) if away else (len(b.text), b.linked, _points(b))
            heading = away is not None and away.tag in ("h1", "h2") and away.order < best.order
            if heading or linked * 2 <= part and (points >= bar or articles[b.node]):
                out.append(b.text)
    return " ".join(out)


def with_main_text(pages: DataFrame, out: str = "main_text") -> DataFrame:
    def extract(texts: pd.Series) -> pd.Series:
        return pd.Series([main_text(t) for t in texts], dtype=object)

    return pages.withColumn(out, F.pandas_udf(extract, "string")(filled("html")))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: its id, address, main text, and the number of its characters."""
    got = with_main_text(pages.select("page_id", "url", "html"), "text")
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
