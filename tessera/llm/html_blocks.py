"""A page's text as a flat list of blocks, each with what the classifier looks at. Pages may be cut short or badly nested."""

from __future__ import annotations

import re
from html import unescape

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements of HTML, and parts of names that page authors give to places.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What is in them is no text of the page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("head template svg math canvas audio video object datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html label legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Opening one of the first closes an open one of the second that isn't beyond one of the third.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
OPEN_P = frozenset({"p"}), frozenset({"button", "table", "td", "th", "caption", "object"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset("article main".split())
BESIDE = frozenset("nav footer aside button select option optgroup label legend fieldset dialog menu noscript search".split())
#: Names of places that hold no part of the article, and of those that only say where on the page they lie.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promoted promotion nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer copyright colophon sitemap related recommended recommendations share sharing social follow subscribe subscription newsletter signup login register search "
    "cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay toast disclaimer comment comments commentlist reply replies respond discussion disqus feedback reviews "
    "pagination pager paging toolbar skip tags poll survey rating hidden complementary contentinfo dialog".split()
)
PLACED = frozenset("header masthead topbar sidebar rail banner widget widgets".split())
CONTENT = frozenset("article content post entry story main body maincontent".split())
#: Beside a place's name they tell of the page as a whole; an article's own names aren't those of what it has.
LAYOUT, ITEM = frozenset("has with without no layout".split()), frozenset("post entry story article hentry".split())
#: What a head holds; anything else ends it.
IN_HEAD = frozenset("title meta link style script base noscript template head html".split())
LINK = frozenset({"a"}), frozenset({"td", "th", "caption", "button", "object"})


class Place:
    """An open element: whether its text is unseen, beside the article, in a form, in the article; and its heading."""

    __slots__ = ("tag", "unseen", "beside", "placed", "form", "article", "heading", "linked")

    def __init__(self, tag: str, up: Place | None):
        self.tag = tag
        self.unseen = self.beside = self.placed = self.form = self.article = self.heading = self.linked = False
        if up:
            self.unseen, self.beside, self.placed, self.form, self.article, self.heading, self.linked = up.unseen, up.beside, up.placed, up.form, up.article, up.heading, up.linked


def _names(attributes: str) -> tuple[set[str], bool]:
    """The parts of an element's class, id and role, and whether it isn't shown."""
    parts: set[str] = set()
    unseen = False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            parts.update(p.lower() for p in NAME_PART.findall(value))
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            unseen = True
    return parts, unseen


def _opened(tag: str, attributes: str, up: Place | None) -> Place:
    p = Place(tag, up)
    if tag in UNSEEN:
        p.unseen = True
    elif tag == "a":
        p.linked = "href" in attributes.lower()
    elif tag in HEADINGS:
        p.heading = True
    elif tag in ARTICLE:
        p.article, p.placed = True, False
    elif tag in BESIDE:
        p.beside = True
    elif tag == "form":
        p.form = True
    elif tag == "header" and not p.article:
        p.placed = True
    if attributes.strip() and tag not in ("html", "body"):
        parts, unseen = _names(attributes)
        p.unseen |= unseen
        if tag in BLOCK:
            if parts & NAMED and not (tag in ARTICLE and parts & ITEM):
                p.beside = True
            elif parts & PLACED and not parts & (CONTENT | LAYOUT):
                p.placed = True
            elif parts & CONTENT:
                p.article = True
                p.placed &= "main" not in parts
    return p


def blocks(page: str | None) -> list[dict]:
    """The blocks in page order: text (character references decoded, white space made single), words, linked (words in links), beside,
    article, heading. A null page has none."""
    out: list[dict] = []
    pieces: list[str] = []
    linked, place = 0, None
    stack: list[Place] = []
    open_: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked, place
        if pieces:
            words = "".join(pieces).split()
            if words and place:
                out.append({"text": " ".join(words), "words": len(words), "linked": min(linked, len(words)), "beside": place.beside or place.placed, "form": place.form, "article": place.article, "heading": place.heading})
            pieces.clear()
        linked, place = 0, None

    def close(k: int) -> None:
        while len(stack) > k:
            open_[stack.pop().tag] -= 1

    def imply(closed: frozenset[str], beyond: frozenset[str]) -> None:
        if any(open_.get(t) for t in closed):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in closed:
                    close(k)
                    return
                if stack[k].tag in beyond:
                    return

    root = Place("", None)
    page = page or ""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        kind = page[lt + 1 : lt + 2] if lt >= 0 else ""
        if lt >= 0 and not (kind.isalpha() and kind.isascii()) and kind not in ("/", "!", "?"):
            stop = lt + 1  # a sign of the text
        else:
            stop = lt if lt >= 0 else n
        if stop > at:
            top = stack[-1] if stack else root
            if not top.unseen:
                text = page[at:stop]
                text = unescape(text) if "&" in text else text
                if not text.isspace():
                    place = place or top
                    if top.linked:
                        linked += len(text.split())
                pieces.append(text)
            at = stop
            continue
        if kind == "!" and page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = n if end < 0 else end + 3
            continue
        m = TAG.match(page, lt) if kind not in ("!", "?") else None
        if not m:
            # a declaration, or a tag that never ends
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            if tag == "br":
                pieces.append(" ")
            elif open_.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if open_.get("head") and tag not in IN_HEAD:
            imply(frozenset({"head"}), frozenset())
        if tag in BLOCK:
            flush()
            imply(*OPEN_P)
            if tag in IMPLIED:
                imply(*IMPLIED[tag])
        elif tag == "a":
            imply(*LINK)
        elif tag == "br":
            pieces.append(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = n if not end else end.start()
        stack.append(_opened(tag, m[3], stack[-1] if stack else root))
        open_[tag] = open_.get(tag, 0) + 1
    flush()
    # a form around the whole page is no form
    inside = sum(b["words"] for b in out if b["form"] and not b["beside"])
    whole = 2 * inside > sum(b["words"] for b in out if not b["beside"])
    for b in out:
        b["beside"] |= b.pop("form") and not whole
    return out


#: What the classifier looks at, in the order of features().
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "beside", "article", "heading")


def features(found: list[dict]) -> list[list[float]]:
    """For each block: its words and link density, those of the blocks before and after it (0 words and links where there is none), whether it is beside the article,
    in the article (1; 0.5 on a page that names no article, 0 outside of it) and a heading."""
    density = [(float(b["words"]), b["linked"] / b["words"]) for b in found]
    named = any(b["article"] and not b["beside"] for b in found)
    none = (0.0, 0.0)
    out = []
    for k, b in enumerate(found):
        before, after = density[k - 1] if k else none, density[k + 1] if k + 1 < len(found) else none
        out.append([*density[k], *before, *after, float(b["beside"]), (float(b["article"]) if named else 0.5), float(b["heading"])])
    return out
