"""Leaf blocks of a page: runs of text between the tags that break lines, each with what its place and text tell.

One pass over the page, linear in its length. Comments, scripts, styles and what is never shown are left out; tags that
are not closed, closed twice or cut off at the end of the page do no harm. A block's features are names: ancestor tags
(``in=nav``), words of their classes, ids and roles (``c=sidebar``), the nearest of each, its own tag, and the shape of
its text. Names of ancestors are shared by all blocks below, so they are kept with the open element.
"""

import html
import re
from typing import NamedTuple

#: Elements that break a line.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without content.
VOID_TAGS = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page; the first ones hold raw text up to their end tag.
RAW_TAGS = ("script", "style", "textarea", "title", "iframe", "noscript", "noframes", "noembed", "xmp")
HIDDEN_TAGS = frozenset("head template svg math object canvas audio video datalist".split())
#: Elements that a head may hold; any other one ends it.
HEAD_TAGS = frozenset("head base link meta script style template title noscript".split())
#: Elements that tell which part of a page something is.
PART_TAGS = frozenset("article aside dialog footer form header main nav search section".split())
#: The end tag of one ends any other.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: A start tag of the first kind ends an open element of the second, within the third.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Words that furniture of a page often holds, in the languages of the corpus.
TELLING_WORDS = frozenset(
    "cookie cookies privacy datenschutz consent accept subscribe newsletter login copyright rights reserved impressum "
    "comment comments reply share tweet sponsored advertisement anzeige publicité publicidad search menu".split()
)

#: Open elements looked through for one that a start tag ends.
NEAR = 64

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<raw>" + "|".join(RAW_TAGS) + r")(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?:[!?/][^>]*+(?:>|\Z)|[a-zA-Z][^<]*+(?:\Z|(?=<)))"
    r"|(?P<text>[^<]++|<)",
    re.DOTALL | re.IGNORECASE,
)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.IGNORECASE) for tag in RAW_TAGS}
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Block(NamedTuple):
    text: str
    features: tuple
    label: bool | None  # of the nearest element marked with data-main, in labelled pages


class _Open(NamedTuple):
    """An open element with what all blocks below it share."""

    tag: str
    names: tuple  # in= and c= of the element and its ancestors, sorted
    part: str  # the nearest element of PART_TAGS, or the body
    words: tuple  # class words of the nearest element that has any
    label: bool | None


_ROOT = _Open("", (), "body", (), None)


def _attributes(rest):
    """Words of class, id and role; whether the element is hidden; its label."""
    words, hidden, label = [], False, None
    for name, value in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "itemprop"):
            words += [w.lower() for w in _NAME_PART.findall(value)]
        elif name == "role":
            words.append("role-" + value.strip().lower())
        elif name == "data-main":
            label = value == "1"
        elif name == "style":
            hidden |= bool(_HIDING.search(value))
        elif name in ("hidden", "aria-hidden"):
            hidden |= value.lower() != "false"
    return tuple(dict.fromkeys(words)), hidden, label


class Contexts:
    """Open elements by parent and start tag, remembered: pages of a site share them."""

    LIMIT = 50_000

    def __init__(self):
        self.known = {}

    def below(self, parent, tag, rest):
        key = parent, tag, rest
        found = self.known.get(key)
        if found is None:
            words, hidden, label = _attributes(rest) if rest else ((), False, None)
            own = {f"in={tag}"} if tag in BLOCK_TAGS else set()
            own.update(f"c={w}" for w in words)
            if hidden:
                own.add("hidden")
            found = _Open(
                tag,
                tuple(sorted(own.union(parent.names))),
                tag if tag in PART_TAGS else parent.part,
                words or parent.words,
                parent.label if label is None else label,
            )
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            self.known[key] = found
        return found


def _shape(text, linked):
    """Features of a block's text, of which ``linked`` characters are in links."""
    words = text.split(" ")
    n = len(words)
    out = [f"words={min(n.bit_length(), 7)}", f"end={text[-1]}" if text[-1] in ".!?:;,…" else "end="]
    share = linked / len(text)
    out.append("linked=0" if not linked else "linked=1" if share < 0.3 else "linked=2" if share < 0.8 else "linked=3")
    if "©" in text:
        out.append("copyright")
    if n <= 40:
        out.extend(f"w={w}" for w in {w.strip(".,!?:;()").lower() for w in words} & TELLING_WORDS)
    return out


class _Page:
    def __init__(self, contexts):
        self.contexts, self.blocks = contexts, []
        self.stack, self.open = [_ROOT], {}
        self.links = self.hidden = 0
        self.parts, self.linked, self.leaf = [], 0, _ROOT

    def text(self, raw):
        if self.stack[-1].tag == "head" and not raw.isspace():
            self.end("head")
        if not self.hidden:
            if not self.parts:
                self.leaf = self.stack[-1]
            self.parts.append((raw, self.links > 0))

    def flush(self):
        """The text since the last line break is a block."""
        parts, self.parts = self.parts, []
        text = " ".join(html.unescape("".join(raw for raw, _ in parts)).split())
        if not text:
            return
        linked = sum(len(raw) for raw, in_link in parts if in_link)
        at, leaf = self.leaf, self._leaf_tag()
        features = [
            *at.names, f"part={at.part}", f"leaf={leaf}", f"spot={at.part}/{leaf}", *[f"near={w}" for w in at.words],
            *_shape(text, min(linked, len(text))),
        ]
        self.blocks.append(Block(text, tuple(features), at.label))

    def _leaf_tag(self):
        for element in reversed(self.stack[-8:]):
            if element.tag in BLOCK_TAGS:
                return element.tag
        return "body"

    def push(self, tag, rest):
        element = self.contexts.below(self.stack[-1], tag, rest)
        self.stack.append(element)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.links += tag == "a"
        self.hidden += tag in HIDDEN_TAGS

    def pop(self):
        tag = self.stack.pop().tag
        self.open[tag] -= 1
        self.links -= tag == "a"
        self.hidden -= tag in HIDDEN_TAGS

    def start(self, tag, rest):
        if self.open.get("head") and tag not in HEAD_TAGS:
            self.end("head")
        if tag in BLOCK_TAGS:
            self.flush()
            if self.open.get("p"):
                self._close(("p",), ("button", "table", "article", "section", "div"))
            if tag in CLOSES:
                self._close(*CLOSES[tag])
        elif tag == "br":
            self.text(" ")
        elif tag == "a" and self.open.get("a"):
            self._close(("a",), BLOCK_TAGS)
        if tag not in VOID_TAGS and not (rest.endswith("/") and tag in HIDDEN_TAGS):
            self.push(tag, rest)

    def _close(self, tags, within):
        """End the innermost open element of these tags, unless one of ``within``, or ``NEAR`` others, are nearer."""
        depth, least = len(self.stack) - 1, max(0, len(self.stack) - 1 - NEAR)
        while depth > least and self.stack[depth].tag not in tags and self.stack[depth].tag not in within:
            depth -= 1
        if depth > least and self.stack[depth].tag in tags:
            while len(self.stack) > depth:
                self.pop()

    def end(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        if tag in HEADINGS and not self.open.get(tag):
            tag = next((t for t in HEADINGS if self.open.get(t)), tag)
        if self.open.get(tag):
            while self.stack[-1].tag != tag:
                self.pop()
            self.pop()


def blocks_of(page, contexts):
    """Blocks (text, features, label) of a page in their order; white space in a text is one space."""
    state, at = _Page(contexts), 0
    while True:
        raw_end = None
        for token in _TOKEN.finditer(page, at):
            kind = token.lastgroup
            if kind == "text":
                state.text(token["text"])
            elif token["tag"]:
                tag = token["tag"].lower()
                if token["end"]:
                    state.end(tag)
                else:
                    state.start(tag, token["rest"])
            elif token["raw"]:
                raw_end = _RAW_END[token["raw"].lower()].search(page, token.end())
                break
        if raw_end is None:
            break
        at = raw_end.end()
    state.flush()
    return state.blocks
