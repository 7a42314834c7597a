"""A page as a run of template tokens: tags at their place in the page, and blocks of text.

:func:`parse` reads a page once, from its start to its end, and keeps the stack of open elements with the ends that
HTML implies.  An element's place is a :class:`Place`: the labels (tag, class and id) from the root down, with what
they say about the text inside.  Places are interned, so a page costs no more than its tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import xxhash

from curio.llm import common

# Elements by what HTML makes of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var img wbr area map picture source".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
LEAF = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote pre td th tr tbody thead tfoot table ul ol dl dt dd figure figcaption caption".split())
#: Elements that an opening one ends, and where the search for them stops.
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
# What elements, roles and the words of class and id say about the text inside.
OUT_TAGS = frozenset("nav footer aside head script style noscript template iframe object svg canvas audio video button select textarea dialog menu".split())
OUT_ROLES = frozenset("navigation contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
OUT_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "toolbar topbar sidebar rail widget footer copyright cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search "
    "share sharing social related recommended recommendations trending popular comment comments reply replies respond discussion disqus".split()
)
#: Beginnings and ends of names that are written as one word.
OUT_PARTS = re.compile(r"^(?:nav|sidebar|footer|comment|cookie|newsletter|advert|breadcrumb|sponsor|popup|related|share|social|ad(?:box|slot|unit|banner|block|wrapper|container)$)|(?:nav|sidebar|footer|comments?|banner|menu|cookies?)$")
#: Out only where no article is around: forms may hold a whole page, headers of articles hold their titles.
SOFT_TAGS, SOFT_ROLES, SOFT_WORDS = frozenset({"form", "header"}), frozenset({"form", "banner"}), frozenset({"header", "masthead", "form"})
#: A name that begins so says what its element stands beside.
BESIDE = frozenset("has with without no is layout".split())
LIKELY = frozenset("content article post entry story articlebody body text main".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_TELLING = re.compile(r"(?:^|[\s\"'])(?:class|id|role|itemprop|style|hidden)\b", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDING = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
OUT, NONE, LIKE, MAIN = -1, 0, 1, 2


class Place:
    """An element's place: labels from the root down."""

    __slots__ = ("below", "container", "hard", "key", "labels", "like", "main", "soft", "tag")

    def __init__(self, above: Place | None, tag: str, described: tuple):
        self.tag, self.below = tag, {}
        names, words, role, hidden = described
        label = tag + "".join(f".{n}" for n in names)
        self.labels = f"{above.labels}>{label}" if above else label
        self.key = xxhash.xxh64_intdigest(self.labels)
        root = tag in ("html", "body")
        self.hard = bool(above and above.hard) or tag in OUT_TAGS or role in OUT_ROLES or hidden or (not root and (bool(words & OUT_WORDS) or any(map(OUT_PARTS.search, words))))
        self.soft = bool(above and above.soft)
        self.main = bool(above and above.main)
        self.like = bool(above and above.like) or (not root and bool(words & LIKELY))
        if tag == "main" or role == "main":
            self.hard = self.soft = False
            self.main = True
        elif tag == "article" or role == "article" or "articlebody" in words:
            self.soft, self.main = False, True
        elif not self.main:
            self.soft = self.soft or tag in SOFT_TAGS or role in SOFT_ROLES or (not root and bool(words & SOFT_WORDS))
        self.container = above.container if above and tag in LEAF else self

    @property
    def role(self) -> int:
        return OUT if self.hard or self.soft else MAIN if self.main else LIKE if self.like else NONE

    def inside(self, tag: str, attributes: str) -> Place:
        described = _described(attributes) if attributes and _TELLING.search(attributes) else _NOTHING
        found = self.below.get((tag, described))
        if found is None:
            found = self.below[tag, described] = Place(self, tag, described)
        return found


_NOTHING: tuple = ((), frozenset(), "", False)


def _described(attributes: str) -> tuple[tuple[str, ...], frozenset[str], str, bool]:
    """Names of class and id without digits, their words, the role, and whether the element is hidden."""
    names, words, role, hidden = [], set(), "", False
    for kind, value in _ATTRIBUTE.findall(attributes):
        kind, value = kind.lower(), value.strip("\"'")
        if kind == "role":
            role = value.strip().lower()
        elif kind == "hidden":
            hidden = True
        elif kind == "style":
            hidden = hidden or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif kind == "itemprop":
            words.add(value.strip().lower())
        elif kind in ("class", "id"):
            for name in value.split():
                parts = [w.lower() for w in _WORDS.findall(name)]
                names.append("-".join(parts))
                if parts and parts[0] not in BESIDE:
                    words.update(parts)
    return tuple(sorted(names)), frozenset(words), role, hidden


def container(labels: str) -> str:
    """The labels of the element that holds paragraphs, list items and the like, of those of one within it."""
    labels = labels.lstrip("\t")
    while labels.rpartition(">")[2].partition(".")[0] in LEAF:
        labels = labels.rpartition(">")[0]
    return labels


class Block(NamedTuple):
    """A run of text between block boundaries: its place in the page, its token number, text and the characters of it that are links."""

    place: Place
    at: int
    text: str
    linked: int


class Page(NamedTuple):
    tokens: list[int]  #: hashes of opening and closing tags at their places, and of blocks
    places: list[Place]  #: where the text after each token stands
    blocks: list[Block]


def _root() -> Place:
    """Interned places, kept with the process and begun anew once they are many."""
    cache = common.process_cache()
    kept = cache.get("places")
    if kept is None or kept[1] > 20_000:
        kept = cache["places"] = [Place(None, "", _NOTHING), 0]
    kept[1] += 1
    return kept[0]


def _pieces(html: str) -> Iterator[tuple[str, str, str, bool]]:
    """(text before, tag or '', attributes, closing) of each piece of markup; the last has no tag."""
    at, n = 0, len(html)
    while at < n:
        m = _MARKUP.search(html, at)
        if m is None:
            break
        tag = m[2]
        if tag is None:
            yield html[at : m.start()], "", "", False
            at = m.end()
            continue
        tag = tag.lower()
        yield html[at : m.start()], tag, m[3].rstrip(">").strip(), bool(m[1])
        at = m.end()
        if tag in RAW and not m[1]:
            end = _ENDING[tag].search(html, at)
            at = end.start() if end else n
    yield html[at:], "", "", False


def parse(html: str | None) -> Page:
    """The tokens and blocks of a page."""
    root = _root()
    stack: list[Place] = [root]
    tokens: list[int] = []
    places: list[Place] = []
    blocks: list[Block] = []
    held: list[str] = []
    linked = link = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            place = stack[-1]
            blocks.append(Block(place, len(tokens), text, min(linked, len(text))))
            tokens.append(xxhash.xxh64_intdigest(text, place.key & 0xFFFFFFFF))
            places.append(place)
        linked = 0

    def close(to: int) -> None:
        """End the elements from the stack's ``to``."""
        while len(stack) > to:
            place = stack.pop()
            tokens.append(place.key ^ 1)
            places.append(stack[-1])

    for before, tag, attributes, closing in _pieces(html or ""):
        if before:
            text = unescape(before) if "&" in before else before
            held.append(text)
            if link:
                linked += len(text.strip())
        if not tag:
            continue
        if tag == "a":
            link = not closing
        if tag in INLINE:
            if not closing and tag not in VOID and attributes and not stack[-1].tag == "pre":
                place = stack[-1].inside(tag, attributes)
                if place.hard and not stack[-1].hard:  # an advert or the like within a line
                    flush()
                    stack.append(place)
                    tokens.append(place.key)
                    places.append(place)
            elif closing and stack[-1].tag == tag:
                flush()
                close(len(stack) - 1)
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if tag in ("html", "body"):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
            continue
        if tag in ENDS:
            ended, stop = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in stop:
                    break
                if stack[k].tag in ended:
                    close(k)
        if tag in ("html", "body") and any(p.tag == tag for p in stack):
            continue
        if tag == "body" and stack[-1].tag == "head":
            close(len(stack) - 1)
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag not in INLINE:
                if stack[k].tag == "p":
                    close(k)
                break
        place = stack[-1].inside(tag, attributes)
        stack.append(place)
        tokens.append(place.key)
        places.append(place)
    flush()
    return Page(tokens, places, blocks)
