"""The main text of a web page, by scoring the containers of its paragraphs.

Each block with text of its own passes points for its length and its commas to the
elements around it, discounted by the share of its text that stands in links and by the
distance. The best container is the article; everything beside it is judged by its points,
its text and its links, bare headings, paragraphs, lists and tables included.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

#: Element names of HTML, by role.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text never belongs to an article.
SKIPPED = frozenset(
    "head script style noscript template title textarea iframe object embed applet canvas svg math audio video map "
    "nav aside footer form fieldset button select option input label menu dialog noembed noframes xmp search".split()
)
#: Words of a class or id that name something beside the article.
ASIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|sidebar\w*|side|comments?|commentlist|disqus|replies|respond|"
    r"cookies?|consent|gdpr|notices?|notification\w*|alert|warning|popup|modal|overlay|newsletter|subscri\w*|signup|login|paywall|"
    r"nav\w*|menus?|breadcrumbs?|pagination|pager|toolbar|masthead|header|footer|foot|copyright|legal|disclaimer|"
    r"share|sharing|social|related|recommend\w*|popular|trending|outbrain|taboola|widgets?|tags|meta|skip|hidden)(?=$|[\s_-])",
    re.I,
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Open elements that a new one ends: fixed values of the HTML standard, in short.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")

#: Points of a container by its element, and parts of the best score that a sibling needs.
BONUS = {"article": 25.0, "main": 20.0, "section": 3.0, "div": 3.0, "td": 1.0, "blockquote": 1.0}
SIBLING_SHARE = 0.2
#: Without these points a sibling needs less than this share of its text in links and, unless
#: it is a heading, paragraph, list or table itself, so many characters.
LINKED_SHARE, LEAST_TEXT = 0.25, 80
BARE = frozenset("h1 h2 h3 h4 h5 h6 hgroup header p pre ul ol dl table blockquote figure".split())
#: What reaches the parent, the one above, and so on, of a block's points.
PASSED = (1.0, 0.5, 0.25)


class Element:
    __slots__ = ("name", "parent", "skipped", "score", "order")

    def __init__(self, name: str, parent: Element | None, skipped: bool, order: int):
        self.name, self.parent, self.skipped, self.score, self.order = name, parent, skipped, 0.0, order


class Block:
    """Text between two borders of block elements, and the element that holds it."""

    __slots__ = ("owner", "text", "linked")

    def __init__(self, owner: Element, text: str, linked: int):
        self.owner, self.text, self.linked = owner, text, linked


def _beside(name: str, attributes: str, parent: Element) -> bool:
    if name in SKIPPED:
        return True
    if name == "header":
        above = parent
        while above is not None and above.name not in ("article", "main", "section"):
            above = above.parent
        return above is None
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if values.get("role", "").lower() in ASIDE_ROLES or values.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes) or re.search(r"display\s*:\s*none", values.get("style", "")):
        return True
    return bool(ASIDE.search(values.get("class", "")) or ASIDE.search(values.get("id", "")))


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, those inside skipped elements left out."""
    root = Element("#root", None, False, 0)
    stack = [root]
    found: list[Block] = []
    pieces: list[str] = []
    linked = order = links = 0

    def close_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                owner = next(e for e in reversed(stack) if e.name in BLOCK or e is root)
                found.append(Block(owner, text, linked))
            pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not stack[-1].skipped:
            pieces.append(text)
            if links:
                linked += len(text)

    def pop_to(index: int) -> None:
        nonlocal links
        for gone in stack[index:]:
            links -= gone.name == "a"
        del stack[index:]

    at = 0
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        match = _TAG.match(page, start) or _LOOSE.match(page, start)  # loose: a quote never ends
        if match is None:  # a plain "<", or a tag that never ends
            add(page[at : start + 1])
            at = start + 1
            continue
        add(page[at:start])
        at = match.end()
        if match[2] is None:
            continue
        name = match[2].lower()
        if name == "br":
            add(" ")
            continue
        if match[1]:
            index = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if index and (name in BLOCK or not any(e.name in ("td", "th", "table", "article") for e in stack[index + 1 :])):
                if name in BLOCK or any(e.name in BLOCK for e in stack[index:]):
                    close_block()
                pop_to(index)
            continue
        if name in BLOCK:
            close_block()
            if name not in ("html", "body"):
                open_p = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name in BLOCK), 0)
                if open_p and stack[open_p].name == "p":
                    pop_to(open_p)
            ends, border = _ENDS.get(name, ((), ()))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in border:
                    break
                if stack[i].name in ends:
                    pop_to(i)
                    break
        parent = stack[-1]
        beside = parent.skipped or _beside(name, match[3], parent)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at) if name != "plaintext" else None
            if not beside:
                add(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            continue
        if name in VOID or match[3].endswith("/") and name not in BLOCK and name != "a":
            continue
        if name == "a":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "a":
                    pop_to(i)
                    break
                if stack[i].name in BLOCK:
                    break
            links += 1
        order += 1
        stack.append(Element(name, stack[-1], beside, order))
    close_block()
    return found


def _belongs(child: Element, length: int, linked: int, best: Element) -> bool:
    """Whether what stands beside the best container is part of the article."""
    if child.skipped:
        return False
    if child.name == "h1" or child.score >= max(10.0, SIBLING_SHARE * best.score):
        return True
    return linked < LINKED_SHARE * length and (child.name in BARE or length >= LEAST_TEXT)


def main_text(page: str) -> str:
    """The blocks of the best container and its worthy siblings, joined by a line break."""
    found = blocks_of(page)
    scored: dict[int, Element] = {}
    for block in found:
        length = len(block.text)
        points = 1 + block.text.count(",") + min(length / 100, 3.0)
        points *= 1 - min(1.0, block.linked / length)
        if block.owner.name in ("li", "dt", "dd", "th", "td", "figcaption", "caption"):
            points *= 0.5
        # text straight in a container counts for it, a paragraph's for what is around it
        above = block.owner.parent if block.owner.name in BLOCK - set(BONUS) and block.owner.parent else block.owner
        for share in PASSED:
            if above is None:
                break
            if above.order not in scored:
                scored[above.order] = above
                above.score = BONUS.get(above.name, 0.0)
            above.score += points * share
            above = above.parent
    if not scored:
        return ""
    best = max(scored.values(), key=lambda e: (e.score, -e.order))
    chosen = {best.order}
    sizes: dict[int, list[int]] = {}
    for block in found:
        above = block.owner
        while above is not None:
            size = sizes.setdefault(above.order, [0, 0])
            size[0] += len(block.text)
            size[1] += min(block.linked, len(block.text))
            above = above.parent
    if best.name not in ("body", "html"):
        top = best  # through wrappers that hold nothing else
        while top.parent is not None and top.parent.name not in ("#root", "body", "html") and sizes[top.parent.order] == sizes[top.order]:
            top = top.parent
        around = top.parent
        for block in found if around is not None else ():
            child = block.owner
            while child is not None and child.parent is not around:
                child = child.parent
            if child is not None and _belongs(child, *sizes[child.order], best):
                chosen.add(child.order)
    kept = []
    for block in found:
        above = block.owner
        while above is not None and above.order not in chosen:
            above = above.parent
        if above is not None:
            kept.append(block.text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, text)``, one row per row of ``pages``: the main text, empty if there is
    none. A null page is empty; text that is not markup is kept as one block.
    """

    def run(raw: list[bytes]) -> dict:
        return {"text": (pa.string(), [main_text(page.decode()) for page in raw])}

    return map_texts(pages, run, "text string", key="page_id", text="html")
