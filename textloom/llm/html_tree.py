"""A small forgiving HTML reader: elements with tag, class path and text, in page order, in time that grows with the page."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import xxhash

# Fixed lists of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"thead", "tbody", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
#: An open p is not closed from inside these.
SCOPES = frozenset("button caption td th table html object marquee template".split())
#: End tags that reach through these.
PASSING = frozenset("body html table td th tr tbody button caption".split())
MASK = (1 << 64) - 1

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
DIGITS = re.compile(r"\d+")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Words of class and id that mark what isn't the article, as a class of their own or beside such words and those of ASIDE; within other
# names ("notice-board") they only propose it ...
CHAFF = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright cta disclaimer "
    "disqus footer gdpr login masthead menu menus modal nav navbar navigation navi newsletter notice notices notification offscreen outbrain overlay pager "
    "pagination paywall popup promoted promotion recommend recommended recommendations related share sharebar sharing sidebar signup skip social "
    "sponsor sponsored sponsors subscribe subscription taboola teaser toolbar tooltip topbar".split()
)
#: ... words that say nothing about what an element holds ...
ASIDE = frozenset("site page main global local top bottom left right primary secondary container wrapper wrap box bar area list lists item items block blocks section sections panel inner outer link links button buttons icon icons row col column module slot unit form count counts post posts entry article wp js my the".split())
#: ... and words that propose it wherever they stand: the host's pages decide (see html_text.judge).
WEAK = frozenset("bar bookmarks discussion dropdown feedback form header hidden metadata popular promo rail reactions replies reply respond responses search side tags toc tracking trending warning widget widgets".split())
DROPPED = frozenset("nav footer aside form button select input textarea script style noscript template svg math canvas iframe object embed dialog menu audio video map head title datalist xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status tooltip".split())
#: Compounds written as one word, such as topnav or cookiebar.
COMPOUND = re.compile(r"(nav|navbar|navigation|menu|footer|sidebar|banner|breadcrumbs?|popup|newsletter|masthead|adbox)$|^(nav|menu|footer|sidebar|cookie|advert|sponsor|newsletter|breadcrumb|subscribe)|^comments?(er|list|box|form|area|section|thread)s?$")
GOOD = frozenset("article post entry story content".split())
#: Chaff even where a good word stands beside it ...
ALWAYS = frozenset("comment comments ad ads advert sidebar footer nav menu related share cookie teaser reply discussion".split())
#: ... unless it only says what the page has besides, as in "content with-sidebar".
BESIDES = frozenset("has with no without".split())
#: Blocks of these that are nothing but links, outside a marked article, may be menu entries.
LINKED = frozenset("li td dd dt div ul ol".split())


@dataclass(slots=True)
class Element:
    tag: str
    path: int  # place in Page.names
    parent: int
    chaff: bool
    good: bool  # an article or main element
    weak: int  # what proposes that this is no part of the article: 0 nothing, 1 a weak word, 2 a sure word within another name
    inside: bool  # in an article or main element, or in one named like an article
    depth: int
    first: int = 0  # blocks from here ...
    last: int = 0  # ... to here belong to the element
    children: list[int] = field(default_factory=list)


@dataclass(slots=True)
class Block:
    text: str
    chaff: bool
    links: bool  # nothing but links, in a list or the like, outside a marked article
    linked: int  # characters inside links
    path: int


@dataclass(slots=True)
class Page:
    """Elements in page order and their blocks; names: (parent path, tag and classes) of each path, so a path costs one entry; hashes: of the whole paths."""

    elements: list[Element]
    blocks: list[Block]
    names: list[tuple[int, str]]
    places: dict[tuple[int, str], int]
    hashes: list[int]

    def path_text(self, path: int) -> str:
        out = []
        while path > 0:
            path, name = self.names[path]
            out.append(name)
        return ">".join(reversed(out))

    def find(self, text: str) -> int:
        """The path that is written like this; -1 if the page hasn't got it."""
        at = 0
        for name in text.split(">") if text else ():
            at = self.places.get((at, name), -1)
            if at < 0:
                break
        return at


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t") else {}


def _sure(token: str) -> tuple[bool, bool]:
    """(only chaff, some chaff) of the words of one class or id."""
    words = [w.lower() for w in PARTS.findall(token) if not w.isdigit()]
    hits = [w in CHAFF or bool(COMPOUND.search(w)) for w in words]
    return any(hits) and all(h or w in ASIDE for h, w in zip(hits, words, strict=True)), any(hits)


def _kind(tag: str, attrs: dict[str, str], inside: bool) -> tuple[bool, bool, int, bool]:
    """(chaff, good, weak, named like an article): by tag, role, visibility and words of class and id. inside: within an article or main element."""
    if tag in DROPPED or tag == "header" and not inside:
        return True, False, 0, False
    if not attrs or tag in ("body", "html"):
        return False, tag in ("article", "main"), 0, False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES:
        return True, False, 0, False
    style = attrs.get("style", "").replace(" ", "").lower()
    if "display:none" in style or "visibility:hidden" in style:
        return True, False, 0, False
    tokens = [*attrs.get("class", "").split(), *attrs.get("id", "").split()]
    words = {w.lower() for t in tokens for w in PARTS.findall(t)}
    strong = tag in ("article", "main") or attrs.get("role") in ("main", "article") or attrs.get("itemprop") == "articleBody"
    wanted = strong or bool(words & GOOD)
    found = [_sure(t) for t in tokens]
    sure, some = any(f[0] for f in found), any(f[1] for f in found)
    if (some or words & WEAK) and (not wanted or words & ALWAYS and not words & BESIDES):
        # within a line, a word proposes nothing: what an inline element holds belongs to its sentence
        return sure, False, 0 if sure or tag not in BLOCK else 2 if some else 1, False
    return False, strong, 0, wanted


def _general(name: str) -> str:
    """A class as it is on the host's other pages: what stands before the first digit."""
    return DIGITS.split(name, maxsplit=1)[0].rstrip("-_").replace(">", "")


def parse(source: str) -> Page:
    """Read a page. Blocks end at block elements; white space in a block is one space; references are decoded."""
    elements = [Element("#root", 0, -1, False, False, 0, False, 0)]
    blocks: list[Block] = []
    names: list[tuple[int, str]] = [(-1, "")]
    places: dict[tuple[int, str], int] = {}
    hashes = [0]
    # open elements; the places in it of each tag, of blocks and of scopes, so that nothing is ever searched for
    stack, where, blocks_at, scopes_at = [0], defaultdict(list), [], []
    text: list[str] = []
    at, n, lower = 0, len(source), None
    # open links; characters of the block inside links; open article and main elements; open inline elements that are dropped with all in them
    link, linked, good_open, muted = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if muted:  # a dropped part of a line doesn't end the line
            return
        if text:
            body = " ".join("".join(text).split())
            text.clear()
            if body:
                own = elements[stack[-1]]
                entry = linked * 10 >= 9 * len(body) and own.tag != "p" and not own.inside and any(elements[k].tag in LINKED for k in stack[-3:])
                blocks.append(Block(body, own.chaff, entry and not own.chaff, min(linked, len(body)), own.path))
        linked = 0

    def close(upto: int) -> None:
        """Close elements from the top of the stack down to this place in it."""
        nonlocal link, good_open, muted
        while len(stack) > upto:
            e = elements[stack[-1]]
            if e.tag in BLOCK:
                flush()
                blocks_at.pop()
            elif e.chaff and not elements[e.parent].chaff:
                muted -= 1
            link -= e.tag == "a"
            good_open -= e.good
            where[e.tag].pop()
            if e.tag in SCOPES:
                scopes_at.pop()
            e.last = len(blocks)
            stack.pop()

    def above_all(tags: Iterable[str]) -> int:
        """The highest place of an open element with one of these tags; 0 if there is none."""
        return max((where[t][-1] for t in tags if where[t]), default=0)

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            if not muted:
                text.append(html.unescape(source[at:]))
            break
        if lt > at and not muted:
            piece = source[at:lt]
            text.append(html.unescape(piece) if "&" in piece else piece)
            linked += len(text[-1]) if link else 0
        mark = source[lt + 1 : lt + 2]
        if mark == "!":
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif source.startswith("<![CDATA[", lt):
                end = source.find("]]>", lt)
                if not muted:
                    text.append(source[lt + 9 : end if end >= 0 else n])
                at = n if end < 0 else end + 3
            else:
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        if mark == "?":
            end = source.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = TAG.match(source, lt) or PLAIN_TAG.match(source, lt)
        if not m:
            if mark == "/" or not mark.isalpha():  # "</" before no name, or a lone sign
                if mark == "/" and (end := source.find(">", lt)) >= 0:
                    at = end + 1
                    continue
                if not muted:
                    text.append("<")
                at = lt + 1
            else:  # a tag that never ends: what follows isn't text
                at = n
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                text.append(" ")
            elif not where[tag]:
                if tag == "p":
                    flush()
            else:
                k = where[tag][-1]
                inline = tag not in BLOCK and tag not in DROPPED and blocks_at and blocks_at[-1] > k  # an inline end tag doesn't close blocks
                barred = tag not in PASSING and scopes_at and scopes_at[-1] > k
                if not inline and not barred:
                    close(k)
            continue
        if tag in CLOSES_P and where["p"] and (not scopes_at or scopes_at[-1] < where["p"][-1]):
            close(where["p"][-1])
        if tag in SIBLINGS:
            while (k := above_all(SIBLINGS[tag])) > above_all(LIMITS[tag]):
                own = elements[stack[k]].tag
                close(k)
                if tag not in ("tr", "tbody", "thead", "tfoot") or own in ("tr", "tbody", "thead"):
                    break
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        parent = stack[-1]
        above = elements[parent]
        attrs = _attributes(m[3])
        chaff, good, weak, named = _kind(tag, attrs, good_open > 0)
        if tag in BLOCK:
            flush()
        path = above.path
        if tag in BLOCK:
            key = path, ".".join([tag, *sorted({_general(c) for c in attrs.get("class", "").split()} - {""})])
            path = places.setdefault(key, len(names))
            if path == len(names):
                names.append(key)
                hashes.append(xxhash.xxh64_intdigest(key[1].encode("utf-8", "surrogatepass"), hashes[key[0]] & MASK))
        good = good and not above.chaff
        e = Element(tag, path, parent, above.chaff or chaff, good, 0 if above.chaff else weak, above.inside or good or named, above.depth + 1, len(blocks), len(blocks))
        elements.append(e)
        above.children.append(len(elements) - 1)
        if tag in RAW:
            if lower is None:
                lower = source.lower()
                if len(lower) != n:  # a letter that grows when lower-cased
                    lower = re.sub(r"[^\x00-\x7f]", "x", source).lower()
            end = lower.find(f"</{tag}", at)
            at = n if end < 0 else end
            if end >= 0:
                close_at = source.find(">", end)
                at = n if close_at < 0 else close_at + 1
            continue
        # a slash at a tag's end closes nothing but what is void anyway
        where[tag].append(len(stack))
        if tag in BLOCK:
            blocks_at.append(len(stack))
        elif chaff and not above.chaff:
            muted += 1
        if tag in SCOPES:
            scopes_at.append(len(stack))
        stack.append(len(elements) - 1)
        link += tag == "a"
        good_open += good
    close(1)
    flush()
    elements[0].last = len(blocks)
    return Page(elements, blocks, names, places, hashes)
