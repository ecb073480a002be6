"""Leaf blocks of an HTML page: text runs between block-level tags, with the tag path that leads to them."""

from __future__ import annotations

import functools
import math
import re
import zlib
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np

#: Fixed sets of HTML element names.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture source input math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg annotation annotation-xml iframe object canvas audio video select datalist option textarea button".split())
#: What may stand in a head; any other start tag or text ends it.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements in which a tag with a slash at its end is closed at once.
FOREIGN = frozenset("svg math".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "option": {"option"}}
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z0-9]+")


@dataclass
class Block:
    text: str
    path: list[str]  # tag, and tag.class / tag#id parts, from the root down
    linked: int = 0  # characters inside links


@dataclass
class _Open:
    tag: str
    names: list[str] = field(default_factory=list)


class Blocks(HTMLParser):
    """Collects a page's blocks; unclosed and misnested tags end where HTML ends them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.hidden = 0
        self.links = 0
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            path = [n for o in self.open for n in o.names if o.tag not in INLINE]
            self.blocks.append(Block(text, path, self.linked))
        self.parts, self.linked = [], 0

    def _pop(self) -> None:
        o = self.open.pop()
        self.hidden -= o.tag in HIDDEN
        self.links -= o.tag == "a"

    def _end_head(self) -> None:
        if self.open and self.open[-1].tag == "head":
            self._pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HEAD:
            self._end_head()
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in VOID:
            if tag not in INLINE:
                self.flush()
            return
        if tag not in INLINE:
            self.flush()
            closes = SELF_CLOSING.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            if closes:
                # Ends an open element of this kind, and the inline ones inside it, within the nearest container.
                for i in range(len(self.open) - 1, -1, -1):
                    t = self.open[i].tag
                    if t in closes:
                        while len(self.open) > i:
                            self._pop()
                        break
                    if t not in INLINE and t != "p":
                        break
        names = [tag]
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                names += [x for w in _NAME.findall(v.lower()) for x in (f"{tag}.{w}", f".{w}")]
        self.open.append(_Open(tag, names))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and any(o.tag in FOREIGN for o in self.open):
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                while len(self.open) > i:
                    self._pop()
                return
            if tag in INLINE and self.open[i].tag not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        if not self.hidden:
            self.parts.append(data)
            self.linked += len(data) if self.links else 0


def blocks(html: str | None) -> list[Block]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


#: Features of a block: hashed tag-path names, hashed words, and a few numbers.
PATH_SLOTS, WORD_SLOTS, NUMBERS = 768, 64, 8
FEATURES = PATH_SLOTS + WORD_SLOTS + NUMBERS


@functools.lru_cache(200_000)
def slot(name: str, slots: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % slots


def features(page: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """One row for each block from ``first`` up to ``last``.  Words are hashed, so that no vocabulary has to be known."""
    n = len(page)
    last = n if last is None else min(n, last)
    out = np.zeros((last - first, FEATURES), np.float32)
    for i, b in enumerate(page[first:last]):
        row = out[i]
        row[path_slots(tuple(b.path))] = 1.0
        words = b.text.lower().split(" ")
        row[PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] = np.bincount([slot(w, WORD_SLOTS) for w in words], minlength=WORD_SLOTS) / len(words)
        size = len(b.text)
        row[PATH_SLOTS + WORD_SLOTS :] = (
            min(1.0, math.log1p(len(words)) / 6),
            min(1.0, math.log1p(size) / 8),
            b.linked / max(size, 1),
            10 * sum(map(b.text.count, ".,;:!?")) / max(size, 1),
            (first + i) / max(n - 1, 1),
            b.text[-1] in ".!?",
            b.text[0].isupper(),
            "©" in b.text,
        )
    return out


@functools.lru_cache(20_000)
def path_slots(path: tuple[str, ...]) -> list[int]:
    leaf = ["leaf " + name for name in path[-2:]]
    return sorted({slot(name, PATH_SLOTS) for name in [*path, *leaf]})
