"""Letters of a paragraph's text nodes changed in place, for use inside tasks."""

from __future__ import annotations

import html
import re

_NODE = re.compile(r"(<w:t(?:\s[^>]*)?(?<!/)>)(.*?)(</w:t>)", re.S)
# What is drawn or boxed is no text of the paragraph that holds it.
_APART = re.compile(r"<(w:drawing|w:pict|w:object|mc:AlternateContent)\b.*?</\1>", re.S)


def nodes(xml: str) -> list[tuple[re.Match, str, int]]:
    """The paragraph's own text nodes with their text and where it begins in the joined text."""
    out, at, apart = [], 0, [m.span() for m in _APART.finditer(xml)]
    for m in _NODE.finditer(xml):
        if not any(a <= m.start() < b for a, b in apart):
            text = html.unescape(m[2])
            out.append((m, text, at))
            at += len(text)
    return out


def replaced(xml: str, start: int, end: int, new: str = "") -> str:
    """``xml`` with the letters from ``start`` to ``end`` of its joined text replaced; ``new`` goes where the first of them was."""
    out, last, pending = [], 0, new
    for m, text, at in nodes(xml):
        if at + len(text) <= start or at >= end:
            continue
        made = text[: max(0, start - at)] + pending + text[max(0, end - at) :]
        pending = ""
        head = m[1]
        if made != made.strip() and "xml:space" not in head:
            head = head[:-1] + ' xml:space="preserve">'
        out += [xml[last : m.start()], head, html.escape(made, quote=False), m[3]]
        last = m.end()
    return "".join([*out, xml[last:]])
