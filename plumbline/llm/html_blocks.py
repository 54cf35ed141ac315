"""Leaf blocks of a page: runs of text between block-level tags, with what their ancestors say about them."""

from __future__ import annotations

import html
import re

BLOCK = frozenset(
    "html body head title div p section article main aside header footer nav h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table "
    "thead tbody tfoot tr td th caption blockquote pre form fieldset figure figcaption address hr center details summary "
    "dialog menu legend option button label select textarea".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: A start tag of these ends an open one of the same set.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
ATTRS = r"(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+"
#: Elements whose content is raw text up to the end tag, or to the end of the page without one.
RAW = frozenset("script style title".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<skip>script|style|title|noscript|template|svg|iframe|object)(?=[\s/>])(?P<own>{ATTRS}|[^>]*)>"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>{ATTRS})>"
    r"|<[!?/][^>]*+>|<[a-zA-Z/][^<>]*+(?:>|\Z)",
    re.S | re.I)
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[a-z]+")


def _ends(page: str, name: str) -> dict[int, int]:
    """Where each element of this name ends, by the place behind its start tag; unclosed ones are missing."""
    out: dict[int, int] = {}
    opened: list[int] = []
    for m in re.finditer(rf"<(/?){name}(?=[\s/>])({ATTRS}|[^>]*)>", page, re.I):
        if not m[1]:
            if not (name == "svg" and m[2].endswith("/")):
                opened.append(m.end())
        elif opened:
            out[opened.pop()] = m.end()
    return out


class Block:
    __slots__ = ("parts", "linked", "active", "tag")

    def __init__(self, active: tuple, tag: str):
        self.parts, self.linked, self.active, self.tag = [], 0, active, tag


def leaf_blocks(page: str, wanted=None) -> list[tuple[str, float, tuple, str]]:
    """(text, share of link text, ancestor features, innermost block tag) of the blocks that hold text.

    Ancestor features are ``tag:<name>`` and ``cls:<word>`` for the words of class, id and role. With ``wanted``
    only those features are kept, which bounds the work on deep pages.
    """
    stack: list[tuple[str, tuple]] = []
    active: dict[str, int] = {}
    blocks: list[Block] = []
    now: Block | None = None
    anchors = 0

    def pop() -> None:
        nonlocal anchors
        tag, features = stack.pop()
        for f in features:
            active[f] -= 1
            if not active[f]:
                del active[f]
        anchors -= tag == "a"

    def put(text: str) -> None:
        nonlocal now
        if not text:
            return
        if now is None:
            inner = next((t for t, _ in reversed(stack) if t in BLOCK), "body")
            now = Block(tuple(active), inner)
            blocks.append(now)
        now.parts.append(text)
        if anchors:
            now.linked += len(text.strip())

    at = 0
    ends: dict[str, dict[int, int]] = {}
    while m := TOKEN.search(page, at):
        if m.start() > at:
            put(html.unescape(page[at:m.start()]))
        at = m.end()
        if m["skip"]:
            name = m["skip"].lower()
            if name in RAW:
                end = RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            elif not (name == "svg" and m["own"].endswith("/")):
                if name not in ends:
                    ends[name] = _ends(page, name)
                at = ends[name].get(at, at)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            put("\n")
        if tag in BLOCK:
            now = None
        if m["end"]:
            if any(t == tag for t, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        if tag in BLOCK:
            # A block ends an open paragraph and what is open inside it.
            if any(t == "p" for t, _ in stack[-8:]):
                while stack[-1][0] != "p":
                    pop()
                pop()
            if tag in CLOSES:
                for depth in range(1, min(len(stack), 4) + 1):
                    if stack[-depth][0] in CLOSES[tag]:
                        for _ in range(depth):
                            pop()
                        break
                    if stack[-depth][0] in ("ul", "ol", "table", "dl"):
                        break
        words = {w for g in NAMES.findall(m["attrs"]) for w in PART.findall("".join(g).lower())} if m["attrs"] else ()
        features = tuple(f for f in (f"tag:{tag}", *(f"cls:{w}" for w in words)) if wanted is None or f in wanted)
        for f in features:
            active[f] = active.get(f, 0) + 1
        stack.append((tag, features))
        anchors += tag == "a"
    put(html.unescape(page[at:]))
    out = []
    for b in blocks:
        text = " ".join("".join(b.parts).split())
        if text:
            out.append((text, min(1.0, b.linked / len(text)), b.active, b.tag))
    return out
