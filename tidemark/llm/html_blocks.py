"""Leaf blocks of a page: their text, tag path and the share of it that is link text."""

from __future__ import annotations

import dataclasses
import html
import re
import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tidemark.llm import textbytes

#: Elements whose whole content is no text of the page.
_DROPPED = "script|style|title|textarea|noscript|template|svg|math|iframe|object|canvas|select|button|datalist"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|(?P<comment>\Z))|<({_DROPPED})\b[^>]*>.*?(?:</\2\s*>|(?P<dropped>\Z))|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_INLINE = frozenset("b i em strong span font small big u s sub sup code kbd samp var cite abbr acronym q tt ins del mark time label bdi bdo dfn data wbr ruby rt rp nobr strike".split())
_VOID = frozenset("area base col embed hr img input link meta param source track".split())
#: An opening tag ends these open elements, up to the nearest container.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_KEEPS_P = _INLINE | {"a", "br"}
_AROUND_P = ("div", "article", "section", "main", "body", "td", "li", "blockquote")


PATHS, WORDS, PLAIN = 192, 64, 8
INPUTS = PATHS + WORDS + PLAIN
#: Nodes that the paths shared between pages may have.
_NODES = 50_000


class Node:
    """An open element below its parent. Pages share the nodes, and with them the vectors, so a deep path costs one node
    an element and no copy a block."""

    __slots__ = ("parent", "element", "children", "_names", "_vector")

    def __init__(self, parent: Node | None, element: str):
        self.parent, self.element = parent, element
        self.children: dict[str, Node] = {}
        self._names = self._vector = None

    @property
    def path(self) -> tuple[str, ...]:
        out, at = [], self
        while at.parent is not None:
            out.append(at.element)
            at = at.parent
        return tuple(reversed(out))

    def names(self) -> np.ndarray:
        """Counts, two at most, of the hashed names of the element and all above it."""
        todo, at = [], self
        while at is not None and at._names is None:
            todo.append(at)
            at = at.parent
        for node in reversed(todo):
            counts = np.zeros(PATHS, dtype=np.uint8) if node.parent is None else node.parent._names.copy()
            for name in node.element.split():
                counts[zlib.crc32(name.encode()) % PATHS] += 1
            node._names = np.minimum(counts, 2)
        return self._names

    def vector(self) -> np.ndarray:
        """`names`, and those of the leaf and its parent once more on their own."""
        if self._vector is None:
            out = self.names().astype(np.int64)
            for depth, node in enumerate((self, self.parent)):
                for name in node.element.split() if node is not None else ():
                    out[zlib.crc32(f"{depth} {name}".encode()) % PATHS] += 1
            self._vector = np.minimum(out, 2).astype(np.uint8)
        return self._vector


class _Shared:
    """The root of the paths; it starts anew once there are too many."""

    root, many = Node(None, ""), 0


@dataclasses.dataclass(slots=True)
class Block:
    text: str
    node: Node  # the innermost open element
    links: int  # code points inside <a>

    @property
    def path(self) -> tuple[str, ...]:
        """One entry per open element: tag, then names from class, id and role."""
        return self.node.path


class _Open:
    """The open elements of a page, with the places of each tag, so that no step depends on the depth."""

    def __init__(self) -> None:
        if _Shared.many > _NODES:
            _Shared.root, _Shared.many = Node(None, ""), 0
        self.nodes, self.tags = [_Shared.root], [""]
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, element: str) -> None:
        above = self.nodes[-1].children
        if element not in above:
            above[element] = Node(self.nodes[-1], element)
            _Shared.many += 1
        self.places.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(above[element])
        self.tags.append(tag)

    def close(self, tag: str, scope: Iterable[str] = ()) -> None:
        """Ends the innermost element of the tag and all inside it, unless one of the scope lies between."""
        at = self._last(tag)
        if at and at > max(map(self._last, scope), default=0):
            for gone in self.tags[at:]:
                self.places[gone].pop()
            del self.nodes[at:], self.tags[at:]

    def _last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0


def blocks(page: str | None) -> list[Block]:
    """The non-empty leaf blocks in page order. White space inside a block is one space; references are decoded. A `<` that
    no `>` follows is text; an unclosed comment or dropped element goes to the end of the page."""
    out: list[Block] = []
    opened = _Open()
    parts: list[tuple[str, bool]] = []
    in_link = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            if text:
                out.append(Block(text, opened.nodes[-1], sum(len(t.strip()) for t, linked in parts if linked)))
            parts.clear()

    page, at = page or "", 0
    last = page.rfind(">") + 1  # no tag ends behind it, so none is searched there
    for m in _TOKEN.finditer(page, 0, last):
        if m.start() > at:
            parts.append((page[at : m.start()], in_link > 0))
        at = len(page) if m["comment"] is not None or m["dropped"] is not None else m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append((" ", False))
        elif tag in _INLINE:
            continue
        elif tag == "a":
            in_link = 0 if m["end"] else 1
        elif tag in _VOID:
            if tag == "hr":
                flush()
        elif m["end"]:
            flush()
            in_link = 0
            opened.close(tag)
        else:
            flush()
            in_link = 0
            if tag not in _KEEPS_P:
                opened.close("p", _AROUND_P)
            for ended in _ENDS.get(tag, ()):
                opened.close(ended, _SCOPE[tag])
            opened.push(tag, _element(tag, m["attributes"]))
    if at < len(page):
        rest = page[at:]
        comment = rest.find("<!--", max(last - at, 0))
        parts.append((rest if comment < 0 else rest[:comment], in_link > 0))
    flush()
    return out


def _element(tag: str, attributes: str) -> str:
    return _named(tag, attributes) if len(attributes) < 1000 else _named.__wrapped__(tag, attributes)


@lru_cache(maxsize=20_000)
def _named(tag: str, attributes: str) -> str:
    names = [tag]
    if attributes:
        for m in _NAMES.finditer(attributes):
            names += re.findall(r"[a-z]+", m[2].lower())
    return " ".join(dict.fromkeys(names))


def vectors(leaves: list[Block]) -> np.ndarray:
    """A row per block: tag-path vector, hashed-word vector (shares of the block's words), and plain counts."""
    out = np.zeros((len(leaves), INPUTS), dtype=np.float32)
    if not leaves:
        return out
    for row, b in zip(out, leaves):
        row[:PATHS] = b.node.vector()
    data, offsets = textbytes.flatten(pa.array([b.text for b in leaves], pa.large_string()))
    low = textbytes.LOWER[data]
    starts, ends, first = textbytes.spans(low, offsets, textbytes.NOT_SPACE)
    n_words = np.diff(first)
    place = np.repeat(np.arange(len(leaves)), n_words) * WORDS + (textbytes.word_hashes(low, starts, ends) % np.uint64(WORDS)).astype(np.int64)
    counts = np.bincount(place, minlength=len(leaves) * WORDS).reshape(-1, WORDS)
    out[:, PATHS : PATHS + WORDS] = counts / np.maximum(n_words, 1)[:, None]
    chars = np.array([len(b.text) for b in leaves])
    links = np.array([b.links for b in leaves])
    body = low[: offsets[-1]]
    stops = np.concatenate(([0], np.cumsum(np.isin(body, list(b".,;:!?")))))
    place = np.linspace(0, 1, len(leaves))
    plain = (np.log1p(n_words) / 5, np.minimum(links / chars, 1), (stops[offsets[1:]] - stops[offsets[:-1]]) / np.maximum(n_words, 1), np.log1p(chars) / 7, place, 1 - place, n_words > 20, np.full(len(leaves), 1.0))
    out[:, PATHS + WORDS :] = np.stack(plain, axis=1)
    return out
