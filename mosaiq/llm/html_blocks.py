"""Pages as sequences of leaf blocks: the text between two block boundaries, with its tag path.

One pass over the page. Tags may be unclosed or crossed: an entry of the stack of open
elements knows the sum of its ancestors' vectors, and the places of open elements are kept
by name, so neither nesting nor missing ends make a tag dearer. A "<" that no tag follows
(another "<" or the end of the page comes before its ">") is text.

Contents of scripts, styles and the like run to their end tag, or to the end of the page.
Text under svg, noscript or template is left out; a block element ends an svg, and ends the
others where no end tag follows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from zlib import crc32

import numpy as np

# Element names by how they shape blocks.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe script style textarea title".split())
HIDDEN = frozenset("noscript svg template".split())
#: What a start tag of this name closes, up to the nearest of the second set.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
IN_PARAGRAPH = frozenset("button label option select".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""")
DECLARATION = re.compile(r"<[!?][^>]*+>")
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")
#: Numbers of a path's vector.
PATH_DIMS = 64


def slot(token: str, dims: int) -> tuple[int, float]:
    """Where a token is hashed to, and its sign."""
    h = crc32(token.encode("utf-8", "surrogatepass"))
    return h % dims, 1.0 if h >> 16 & 1 else -1.0


@lru_cache(maxsize=20_000)
def _own_vector(name: str, attributes: str, leaf: bool = False) -> np.ndarray:
    """Of an element itself: its name, and words of its class, id and role."""
    out = np.zeros(PATH_DIMS, np.float32)
    words = [f".{w}" for a in ATTRIBUTE.finditer(attributes) for w in NAME.findall((a[2] or a[3] or a[4] or "").lower())]
    for token in [f"/{name}"] if leaf else [name, *words]:
        at, sign = slot(token, PATH_DIMS)
        out[at] += sign
    return out


@lru_cache(maxsize=100)
def _end_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I)


@dataclass
class Block:
    path: np.ndarray
    depth: int
    text: str
    link_chars: int


class OpenElements:
    """The stack of open elements; each step takes constant time, counted over a page."""

    def __init__(self):
        self.names, self.paths = [], [np.zeros(PATH_DIMS, np.float32)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, *names: str) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def push(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.blocks.append(len(self.names))
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.paths.append(self.paths[-1] + _own_vector(name, attributes))

    def forget(self, at: int) -> None:
        """The innermost element of its name is no longer open, though those inside it are."""
        self.places[self.names[at]].pop()
        self.names[at] = None

    def pop(self, at: int) -> None:
        """Close the element at a place and all inside it."""
        for k in range(len(self.names) - 1, at - 1, -1):
            if self.names[k] is not None:
                self.places[self.names[k]].pop()
            if self.blocks and self.blocks[-1] == k:
                self.blocks.pop()
        del self.names[at:], self.paths[at + 1 :]

    def close(self, names: str, until: str) -> None:
        if (at := self.last(*names.split())) > self.last(*until.split()):
            self.pop(at)

    def end(self, name: str) -> None:
        """An end tag: of a block element it closes all inside; of another one only if no block is."""
        if (at := self.last(name)) >= 0:
            if name in BLOCKS or not self.blocks or self.blocks[-1] < at:
                self.pop(at)
            else:
                self.forget(at)


def leaf_blocks(html: str) -> list[Block]:
    """All blocks of a page that hold text, in page order."""
    out: list[Block] = []
    opened, parts = OpenElements(), []
    path, depth, linked = opened.paths[0], 0, 0
    last_end, ends = html.rfind(">"), {}

    def add(text: str) -> None:
        nonlocal path, depth, linked
        if not text or opened.last(*HIDDEN) >= 0 or not (parts or text.strip()):
            return
        if not parts:
            path, depth = opened.paths[-1] + _own_vector(opened.names[-1] or "", "", True) if opened.names else opened.paths[0], len(opened.names)
        if opened.places.get("a"):
            linked += len(text)
        parts.append(text)

    def end_block() -> None:
        nonlocal linked
        if text := SPACES.sub(" ", unescape("".join(parts))).strip():
            out.append(Block(path, depth, text, linked))
        parts.clear()
        linked = 0

    def is_ended(name: str, at: int) -> bool:
        """Whether an end tag of this name comes after a place."""
        if name not in ends:
            ends[name] = max((m.start() for m in _end_tag(name).finditer(html)), default=-1)
        return ends[name] >= at

    at, size = 0, len(html)
    while at < size:
        start = html.find("<", at)
        if start < 0 or start > last_end and not html.startswith("<!--", start):
            add(html[at:])
            break
        add(html[at:start])
        if html.startswith("<!--", start):
            at = html.find("-->", start + 4)
            at = size if at < 0 else at + 3
            continue
        m = TAG.match(html, start)
        if m is None:
            m = DECLARATION.match(html, start)
            add("<") if m is None else None
            at = m.end() if m else start + 1
            continue
        at, name = m.end(), m[2].lower()
        is_block = name in BLOCKS
        if is_block or name in RAW:
            end_block()
        if is_block and not m[1]:
            for hider in HIDDEN:
                while (k := opened.last(hider)) > (opened.last("foreignobject") if hider == "svg" else -1) and (hider == "svg" or not is_ended(hider, at)):
                    opened.pop(k)
        if name == "br":
            add("\n") if parts else None
        elif m[1]:
            opened.end(name)
        elif name in RAW:
            if not m[3].endswith("/"):
                stop = _end_tag(name).search(html, at)
                at = html.find(">", stop.end()) + 1 if stop and stop.end() <= last_end else size
        else:
            if is_block and name not in IN_PARAGRAPH:
                opened.close("p", "button td th li dd article section div")
            if name in CLOSES:
                opened.close(*CLOSES[name])
            if name not in VOID and not m[3].endswith("/"):
                opened.push(name, m[3])
    end_block()
    return out
