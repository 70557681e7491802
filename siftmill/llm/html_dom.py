"""A forgiving reader of HTML into arrays of nodes."""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe template textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
# Formulas stand in their line, but end tags of theirs close what is in them.
_FLOWING = INLINE | frozenset("math semantics mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mstyle mspace".split())
# A start tag of the key closes an open one of these, up to the nearest of the scopes.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}
_P_CLOSERS = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
_P_SCOPE = frozenset("button table td th caption html body object".split())
_MARKUP = re.compile(
    r"<!--(?:.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|"
    r"<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_TOKEN = re.compile(r"[a-z]+")
ATTRIBUTES = ("class", "id", "role", "itemprop", "aria-label")


class Dom:
    """Nodes in page order; parents come before their children.

    ``tags`` is "#text" for text. Text has its ``texts`` entry, character
    references decoded, and the ``blocks`` number of the block it belongs to:
    text of one block follows on without a break. Other nodes have the word
    parts of their telling attributes in ``tokens``.
    """

    def __init__(self, source: str, keep: str | None = None):
        self.tags: list[str] = ["#root"]
        self.parents: list[int] = [-1]
        self.tokens: list[tuple[str, ...]] = [()]
        self.texts: list[str] = [""]
        self.blocks: list[int] = [0]
        self.marks: list[str | None] = [None]  # value of the attribute ``keep``
        self._stack, self._block = [0], 0
        # places in the stack of what is open, by tag, and of what is no inline tag: nothing is searched for
        self._open_at: dict[str, list[int]] = {}
        self._blocks_at: list[int] = []
        at, end = 0, len(source)
        while at < end:
            found = _MARKUP.search(source, at)
            if found is None:
                self._text(source[at:])
                break
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            closing, opening = found[1], found[2]
            if closing:
                self._close(closing.lower())
            elif opening:
                tag = opening.lower()
                self._open(tag, found[3], keep)
                if tag in RAW and not (found[3].endswith("/") and self._is_whole(tag, source, at)):
                    # what is inside is no markup; without an end tag, up to the end
                    stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
                    if found[3].endswith("/"):
                        self._push(len(self.tags) - 1)
                    self._text(source[at : stop.start() if stop else end])
                    at = stop.end() if stop else end
                    self._close(tag)

    @staticmethod
    def _is_whole(tag: str, source: str, at: int) -> bool:
        """Whether a raw tag that closes itself has no end tag of its own: none comes, or another start tag comes first."""
        following = re.compile(rf"<(/?){tag}(?=[\s/>])", re.IGNORECASE).search(source, at)
        return following is None or not following[1]

    def _add(self, tag: str, tokens: tuple[str, ...], text: str, mark: str | None = None) -> int:
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.tokens.append(tokens)
        self.texts.append(text)
        self.blocks.append(self._block)
        self.marks.append(mark)
        return len(self.tags) - 1

    def _text(self, raw: str) -> None:
        self._add("#text", (), html.unescape(raw) if "&" in raw else raw)

    def _open(self, tag: str, attributes: str, keep: str | None) -> None:
        if tag in _P_CLOSERS:
            self._close_up_to(("p",), _P_SCOPE)
        elif tag in _CLOSES:
            self._close_up_to(*_CLOSES[tag])
        if tag not in _FLOWING and tag != "br":
            self._block += 1
        tokens: list[str] = []
        mark = None
        if "=" in attributes:
            for name, *values in _ATTRIBUTE.findall(attributes):
                name = name.lower()
                if name in ATTRIBUTES:
                    tokens += _TOKEN.findall("".join(values).lower())
                elif name == keep:
                    mark = "".join(values)
        if tag == "br":
            self._add("#text", (), " ")
        node = self._add(tag, tuple(tokens), "", mark)
        if tag not in VOID and not attributes.endswith("/"):
            self._push(node)

    def _push(self, node: int) -> None:
        depth = len(self._stack)
        self._open_at.setdefault(self.tags[node], []).append(depth)
        if self.tags[node] not in INLINE:
            self._blocks_at.append(depth)
        self._stack.append(node)

    def _pop_down_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            tag = self.tags[self._stack.pop()]
            self._open_at[tag].pop()
            if tag not in INLINE:
                self._blocks_at.pop()

    def _nearest(self, *tags: str) -> int:
        """Depth of the innermost open one of these, 0 without any."""
        return max((places[-1] for tag in tags if (places := self._open_at.get(tag))), default=0)

    def _close_up_to(self, tags, scopes) -> None:
        depth = self._nearest(*tags)
        if depth > self._nearest(*scopes):
            self._pop_down_to(depth)
            self._block += 1

    def _close(self, tag: str) -> None:
        if tag not in _FLOWING:
            self._block += 1
        depth = self._nearest(tag)
        # an inline end tag does not close blocks
        if depth and not (tag in INLINE and self._blocks_at and self._blocks_at[-1] > depth):
            self._pop_down_to(depth)
