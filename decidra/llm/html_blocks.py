"""HTML as a sequence of leaf blocks, and the vectors that a block labeller reads."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np

BREAKS = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Text in these is never main text: scripts, styles, what stands in for them or for media that are not shown, drawings, and a form's field.
HIDDEN = frozenset("script style noscript template svg iframe canvas audio video map textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A new block of these kinds ends an open one of the same kind.
ALIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
PATH, LEAF, WORDS, NUMBERS = 160, 32, 64, 6
WIDTH = PATH + LEAF + WORDS + NUMBERS
#: The attribute that marks main text in training pages; never a feature.
MARK = "data-main-text"


#: Tags at which the search for an open block to end stops, found or not.
CONTAINERS = frozenset("table ul ol dl article section div body".split())
ENDED = frozenset({"p", *(t for tags in ALIKE.values() for t in tags)})


def _place(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


_named: dict[tuple[str, ...], int] = {}


def _word_bits(names: tuple[str, ...]) -> int:
    bits = _named.get(names)
    if bits is None:
        bits = 0
        for name in names:
            bits |= 1 << _place("." + name, PATH)
        if len(_named) > 20_000:
            _named.clear()
        _named[names] = bits
    return bits


class _Open:
    """A tag of the page's tree. What a whole path says is carried from tag to tag, so a block costs the same at any depth."""

    __slots__ = ("tag", "names", "up", "at", "bits", "leaf", "linked", "marked", "ender", "size", "heads")

    def __init__(self, tag: str, names: tuple[str, ...], marked: bool, up: _Open | None, at: int):
        self.tag, self.names, self.up, self.at = tag, names, up, at
        self.bits = self.size = self.heads = 0
        self.leaf = tag if tag in BREAKS else up.leaf if up else None
        self.linked = tag == "a" or up is not None and up.linked
        self.marked = marked or up is not None and up.marked
        # the next tag outwards that a new block may end, or that shields those behind it
        self.ender = None if up is None else up if up.tag in CONTAINERS or up.tag in ENDED else up.ender


def _wraps(own: _Open, size: int, heads: int) -> bool:
    """Whether a tag wraps the page: then its class words tell nothing about a block, whatever they are. It does if nearly all text
    is in it, or more than half together with the page's headings of the first rank."""
    return own.tag in ("html", "body") or 20 * own.size >= 19 * size or 2 * own.size > size and heads > 0 and own.heads == heads


def _tell(tree: list[_Open]) -> None:
    """Gives every tag the bits of its path: all tags, and the class words of those that do not wrap the page."""
    for own in reversed(tree):
        own.heads += own.tag == "h1"
        if own.up is not None:
            own.up.size += own.size
            own.up.heads += own.heads
    size, heads = (sum(getattr(x, k) for x in tree if x.up is None) for k in ("size", "heads"))
    for own in tree:
        own.bits = 1 << _place(own.tag, PATH) | (own.up.bits if own.up else 0)
        if own.names and not _wraps(own, size, heads):
            own.bits |= _word_bits(own.names)


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.tree: list[_Open] = []
        self.n_open: Counter[str] = Counter()
        self.found: list[tuple[str, _Open | None, float]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.hidden = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.open[-1] if self.open else None
            self.found.append((text, top, min(1.0, self.linked / len(text))))
            if top:
                top.size += len(text)
        self.parts, self.linked = [], 0

    def close_to(self, at: int) -> None:
        for own in self.open[at:]:
            self.n_open[own.tag] -= 1
            self.hidden -= own.tag in HIDDEN
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        if tag in BREAKS:
            self.flush()
            stop = ALIKE.get(tag, ()) + (("p",) if tag != "label" and tag != "button" else ())
            own = self.open[-1] if self.open else None
            while own is not None:
                if own.tag in stop:
                    self.close_to(own.at)
                    break
                if own.tag in CONTAINERS:
                    break
                own = own.ender
        if tag not in VOID:
            named = dict(attrs)
            names = tuple(re.findall(r"[a-z]+", f"{named.get('class') or ''} {named.get('id') or ''} {named.get('role') or ''}".lower()))
            self.open.append(_Open(tag, names, MARK in named, self.open[-1] if self.open else None, len(self.open)))
            self.tree.append(self.open[-1])
            self.n_open[tag] += 1
            self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BREAKS:
            self.flush()
        if self.n_open[tag]:
            at = len(self.open) - 1
            while self.open[at].tag != tag:
                at -= 1
            self.close_to(at)

    def handle_data(self, data):
        if self.hidden:
            return
        self.parts.append(data)
        if self.open and self.open[-1].linked:
            self.linked += len(data)


def blocks(html: str) -> list[tuple[str, int, float, bool]]:
    """(text, bits of its path's hashed tags and class words, share of linked characters, marked) of every leaf block, in
    page order.

    Character references are decoded, white space is one space, scripts and the like are left out. Broken markup is
    read on as browsers do: a paragraph ends where the next block starts, and a stray end tag is ignored. Time grows with
    the length of the page, however deep its tags nest."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    _tell(parser.tree)
    bits = lambda own: own.bits | 1 << PATH + _place(own.leaf or own.tag, LEAF) if own else 0
    return [(text, bits(own), linked, own is not None and own.marked) for text, own, linked in parser.found]


def vectors(found: list[tuple[str, int, float, bool]]) -> np.ndarray:
    """A row for each block: tag path, hashed words, and a few numbers."""
    out = np.zeros((len(found), WIDTH), np.float32)
    packed = np.frombuffer(b"".join(bits.to_bytes((PATH + LEAF) // 8, "little") for _, bits, _, _ in found), np.uint8)
    out[:, : PATH + LEAF] = np.unpackbits(packed, bitorder="little").reshape(len(found), PATH + LEAF)
    for i, (text, _, linked, _) in enumerate(found):
        words = text.split(" ")
        at = PATH + LEAF
        counts = np.bincount([hash_word(w) for w in words], minlength=WORDS)
        out[i, at : at + WORDS] = np.sqrt(counts / len(words))
        out[i, at + WORDS :] = (np.log1p(len(text)) / 8, np.log1p(len(words)) / 6, linked, sum(map(text.count, ".,;:!?")) / len(words), i / len(found), text[-1] in ".!?\"")
    return out


_words: dict[str, int] = {}


def hash_word(word: str) -> int:
    n = _words.get(word)
    if n is None:
        if len(_words) > 200_000:
            _words.clear()
        n = _words[word] = _place(word.lower().strip(".,;:!?"), WORDS)
    return n
