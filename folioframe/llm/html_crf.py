"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: runs of text between block-level tags.  Each
block has features of its ancestor tags (tag names, words of class and id) and
of its text (length, link share, sentence ends).  A two-label chain (article or
not), trained on labelled pages by gradient ascent on the conditional
likelihood, is decoded by Viterbi, and the article blocks are joined.

Pages are independent: no shuffle, one page in memory at a time.  The model is
a few hundred weights, sent to the tasks.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Container
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text
from .html_pages import MARK, labelled_pages

#: Labelled pages the chain is trained on; a bound of the training data.
TRAINING_PAGES = 1500
#: Pages that must show a feature before it gets a weight.
LEAST_PAGES = 3
#: Letters of a block that ends like a sentence and is taken for prose; four times as many without such an end.
PROSE_LETTERS = 40

# Tags whose contents are no text, those of them that run to the
# end of the page if unclosed, tags that break no block, tags without an end.
_RAW = ("script", "style", "title", "textarea", "iframe", "noscript", "template", "svg", "object", "canvas")
_RAW_TO_END = frozenset(_RAW[:5])
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img area base embed input link meta param source track".split())
_VOID = frozenset("col hr".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME_WORD = re.compile(r"[a-z]+")
_RIGHTS = re.compile(r"\bcopyright\b|\ball rights reserved\b", re.I)


class Block:
    """A leaf block: its text, the features of its ancestors (shared between blocks) and its own."""

    __slots__ = ("text", "above", "own")

    def __init__(self, text: str, above: tuple[str, ...], own: tuple[str, ...]):
        self.text, self.above, self.own = text, above, own

    @property
    def features(self) -> tuple[str, ...]:
        return (*self.above, *self.own)


def blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """The page's leaf blocks that hold text, in page order.

    Character references are decoded, white space is one space.  Unclosed and
    stray tags are borne: an end tag closes up to its opening, or nothing; a
    paragraph ends where the next block begins.  Ancestors' features are kept if
    ``known`` (by default all); an element that adds none shares its parent's,
    so that time and memory grow with the page and not with its depth.
    """
    out: list[tuple[str, int, tuple[str, ...], str]] = []
    stack: list[tuple[str, tuple[str, ...]]] = [("", ())]
    opened, unclosed = Counter(), set()
    parts: list[str] = []
    linked = at = 0
    in_link = False

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, linked, stack[-1][1], stack[-1][0]))
            parts.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            linked += len(piece) * in_link

    while at < len(page):
        token = _TOKEN.search(page, at)
        if token is None:
            say(page[at:])
            break
        say(page[at : token.start()])
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if tag in _RAW_END:
            if not token[1]:
                end = None if tag in unclosed or token[3].endswith("/") else _RAW_END[tag].search(page, at)
                if end:
                    at = end.end()
                elif not token[3].endswith("/"):
                    unclosed.add(tag)
                    at = len(page) if tag in _RAW_TO_END else at
                close()
            continue
        if tag in _INLINE:
            in_link = not token[1] if tag == "a" else in_link
            continue
        if tag == "br":
            parts.append(" ")
            continue
        close()
        in_link = False
        if tag in _VOID:
            continue
        if token[1]:
            while opened[tag]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == tag:
                    break
            continue
        if stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or stack[-1][0] == tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
            opened[stack.pop()[0]] -= 1
        above = stack[-1][1]
        names = [f"name:{w}" for m in _NAMES.finditer(token[3]) for w in _NAME_WORD.findall((m[1] or m[2] or m[3] or "").lower())] if token[3] else []
        new = [f for f in dict.fromkeys((f"in:{tag}", *names)) if f not in above and (known is None or f in known)]
        stack.append((tag, (*above, *new) if new else above))
        opened[tag] += 1
    close()
    last = len(out) - 1
    return [Block(text, above, (f"own:{own}", *_text_features(text, linked, i, last, own))) for i, (text, linked, above, own) in enumerate(out)]


def _text_features(text: str, linked: float, i: int, last: int, tag: str) -> list[str]:
    share = min(4, int(5 * linked / len(text)))
    features = ["bias", f"length:{min(len(text).bit_length(), 11)}", f"links:{share}", f"sentences:{min(3, text.count('.') + text.count('!') + text.count('?'))}"]
    prose = len(text) >= PROSE_LETTERS and not linked and text.count(" ") >= 6 and text[-1] in ".!?…\"'”’)" or len(text) >= 4 * PROSE_LETTERS and share == 0
    kind = "prose" if prose else "other"
    features += [kind, f"{kind}:{tag}"]
    if i == 0:
        features.append(f"first:{kind}")
    if i == last:
        features.append(f"last:{kind}")
    if "©" in text or _RIGHTS.search(text):
        features.append("copyright")
    return features


class Chain:
    """Weights of the two-label chain: per feature, start, and 2 x 2 transitions."""

    def __init__(self, weights: dict[str, float], start: float, step: np.ndarray):
        self.weights, self.start, self.step = weights, float(start), [[float(x) for x in row] for row in step]

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi: the likeliest labels of a page's blocks (ties: not article)."""
        if not page:
            return []
        get, (same_out, enter), (leave, same_in) = self.weights.get, *self.step
        out, into, back, shared = 0.0, self.start, [], {}
        for k, block in enumerate(page):
            if id(block.above) not in shared:
                shared[id(block.above)] = sum([get(f, 0.0) for f in block.above])
            here = shared[id(block.above)] + sum([get(f, 0.0) for f in block.own])
            if k == 0:
                into += here
                continue
            a, b, c, d = out + same_out, into + leave, out + enter, into + same_in
            back.append((b > a, d > c))
            out, into = max(a, b), max(c, d) + here
        labels = [into > out]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]

    def main_text(self, page: str | None) -> str:
        own = blocks(page or "", self.weights)
        return " ".join([b.text for b, keep in zip(own, self.decode(own)) if keep])


def train(pages: list[str], rounds: int = 500, rate: float = 0.5, ridge: float = 1e-4) -> Chain:
    """Fits a chain to labelled pages (article text begins with ``MARK``)."""
    parsed = [p for p in (blocks(x) for x in pages) if p]
    labels = [[MARK in b.text for b in p] for p in parsed]
    clean = [blocks(x.replace(MARK, "")) for x in pages]
    clean = [p for p in clean if p]
    held = Counter(f for p in clean for f in {f for b in p for f in b.features})
    names = sorted(f for f, n in held.items() if n >= LEAST_PAGES)
    index, width, n = {f: i for i, f in enumerate(names)}, max(map(len, clean)), len(clean)
    x = np.zeros((n, width, len(names)), dtype=np.float32)
    y, real = np.zeros((n, width), dtype=int), np.zeros((n, width), dtype=bool)
    for i, (p, own) in enumerate(zip(clean, labels)):
        for k, b in enumerate(p):
            real[i, k], y[i, k] = True, own[k]
            x[i, k, [index[f] for f in b.features if f in index]] = 1
    flat = x[real]
    w, start, step = np.zeros(len(names)), 0.0, np.zeros((2, 2))
    seen = [np.full(len(names), 1e-6), 1e-6, np.full((2, 2), 1e-6)]
    total = real.sum()
    for _ in range(rounds):
        emit = np.zeros((n, width, 2))
        emit[:, :, 1][real] = flat @ w.astype(np.float32)
        forward, backward = np.zeros((n, width, 2)), np.zeros((n, width, 2))
        forward[:, 0] = emit[:, 0] + [0.0, start]
        for k in range(1, width):
            came = np.logaddexp(forward[:, k - 1, :1] + step[:1], forward[:, k - 1, 1:] + step[1:]) + emit[:, k]
            forward[:, k] = np.where(real[:, k, None], came, forward[:, k - 1])
        for k in range(width - 2, -1, -1):
            after = emit[:, k + 1] + backward[:, k + 1]
            goes = np.logaddexp(step[:, 0][None] + after[:, :1], step[:, 1][None] + after[:, 1:])
            backward[:, k] = np.where(real[:, k + 1, None], goes, 0.0)
        norm = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        marginal = np.exp(forward + backward - norm[:, None, None])[:, :, 1] * real
        gap = (y - marginal) * real
        g_w = (gap[real].astype(np.float32) @ flat) / total - ridge * w
        g_start = gap[:, 0].mean()
        g_step = np.zeros((2, 2))
        for k in range(1, width):
            pair = np.exp(forward[:, k - 1, :, None] + step + (emit[:, k] + backward[:, k])[:, None, :] - norm[:, None, None])
            true = np.zeros((n, 2, 2))
            true[np.arange(n), y[:, k - 1], y[:, k]] = 1
            g_step += ((true - pair) * real[:, k, None, None]).sum(axis=0)
        g_step = g_step / total - ridge * step
        for s, g in zip(range(3), (g_w, g_start, g_step)):
            seen[s] = seen[s] + g * g
        w += rate * g_w / np.sqrt(seen[0])
        start += rate * g_start / np.sqrt(seen[1])
        step += rate * g_step / np.sqrt(seen[2])
    return Chain(dict(zip(names, w.tolist())), start, step)


@lru_cache(maxsize=1)
def trained(n_pages: int = TRAINING_PAGES) -> Chain:
    return train(labelled_pages(n_pages))


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), chain: Chain | None = None) -> DataFrame:
    """``keep`` columns plus ``text`` (main text, "" if none) and ``n_chars`` (its code points).

    Null html counts as empty.  Rows are independent, so repeated rows give
    repeated results and an empty table an empty one.  Pages of any length and
    depth are read whole; of equally likely labels, not article.
    """
    shared = df.sparkSession.sparkContext.broadcast(chain or trained())

    def row(page):
        text = shared.value.main_text(page)
        return text, len(text)

    return per_text(df, html_col, keep, [("text", "string", pa.string()), ("n_chars", "long", pa.int64())], row)
