"""HTML to leaf blocks: a small tolerant tokenizer and a stack of open elements.

A block is the text between two borders of non-inline elements, in page order,
with the path of open elements (tag, class and id words). Script, style and
other raw-text elements, comments, declarations and markup give no text. Tags
cut off by the end of the page are dropped, as are unclosed raw-text elements.
"""

from __future__ import annotations

import html
import re

# Elements whose borders do not end a block, elements without
# content, elements whose content is not text of the page, and elements that
# end an open paragraph.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style title textarea xmp iframe noembed noframes"
SELF_ENDING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + RAW.replace(" ", "|") + r")(?=[\s/>]|\Z)(?:.*?</(?P=raw)(?=[\s/>]|\Z)[^>]*(?:>|\Z)|.*\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|(?P<open>\Z))"
    r"|<(?P<close2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|(?P<open2>\Z))",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")


class Block:
    """Text of a leaf, the path of open elements above it, characters in links."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def _names(tag: str, rest: str) -> tuple[str, ...]:
    words = []
    for value in _NAMES.findall(rest):
        words += _WORDS.findall(value.lower())
    return (tag, *(f".{w}" for w in words))


def blocks(page: str | None) -> list[Block]:
    """The non-empty leaf blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    inside_link, parts, linked = 0, [], 0
    names: dict[tuple[str, str], tuple[str, ...]] = {}

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path = tuple(x for tag, own in stack if tag not in INLINE for x in own)
                out.append(Block(path, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(html.unescape(piece))  # a reference ends where markup begins
            if inside_link:
                linked += len(piece)

    def pop_to(at: int) -> None:
        nonlocal inside_link
        for tag, _ in stack[at:]:
            inside_link -= tag == "a"
        del stack[at:]

    page, at = page or "", 0
    for m in _MARKUP.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if m["raw"]:
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None or m["open"] is not None or m["open2"] is not None:
            continue
        tag, rest = tag.lower(), m["rest"] or m["rest2"] or ""
        if m["close"] or m["close2"]:
            if tag not in INLINE:
                end_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag == "br":
            text(" ")
        if tag not in INLINE:
            end_block()
            stops = SELF_ENDING.get(tag)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stops and stack[i][0] == tag:
                    pop_to(i)
                    if stack[i:] or not stops:
                        break
                elif stack[i][0] not in INLINE and not (stops and stack[i][0] not in stops):
                    break
        if tag not in VOID:
            key = (tag, rest)
            if key not in names:
                names[key] = _names(tag, rest)
            stack.append((tag, names[key]))
            inside_link += tag == "a"
    text(page[at:])
    end_block()
    return out
