"""Problem 5: clean text with its structure out of HTML, Markdown, wiki and LaTeX, whatever is declared.

Method: a linear-chain conditional random field over the leaf blocks of a document. A block's features are its ancestor tags,
properties of its text and of its neighbours' texts; its label is one of ``LABELS``, ``drop`` standing for residue (navigation,
scripts, styles, preambles, comments, templates, floats). The field is trained where it is used, by gradient ascent on the likelihood,
on at most ``SAMPLE`` pages (the documented bound; the pages with the least hashes); every document is then decoded by Viterbi.

Labels come from the tags of well-marked pages (``teacher``), but each page is learnt twice, as it is and with its tags taken off, so
that the field knows what headings, entries, code, formulas and residue look like in themselves. Where tags say what a block is they
decide; where they say nothing (``NEUTRAL`` containers, or none at all) the text and the chain do, which ``teacher`` can't.

Edge cases: null, empty and blank bodies have no blocks; bodies without any markup are paragraphs; unclosed tags end with what
encloses them; very long bodies are read whole; an empty table trains nothing and gives no rows; repeated rows and equal blocks of
one article come once; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markup import Leaf, leaves

LABELS = ("heading", "para", "item", "code", "formula", "drop")
SAMPLE, STRETCH = 600, 40
_SPACE = re.compile(r"\s+")
_DISPLAY = re.compile(r"^\s*(?:\$\$(?P<a>.+)\$\$|\\\[(?P<b>.+)\\\])\s*$", re.S)


def squeezed(s: str) -> str:
    return _SPACE.sub("", s)


NEUTRAL = {"div", "span", "section", "article", "main", "body", "figure", "form", "address", "html", "?"}
_BULLET = re.compile(r"^\s*(?:[-*•・●○◦▪‣]|[(（]?\d{1,3}[.)）、:]|[A-Za-z][.)])\s*\S")
_CODE = re.compile(r"\b(?:def|return|import|from|function|var|let|const|class|for|while|print|echo|sudo|select|fn|pub|end|null|true|false)\b|[=!<>+-]=|=>|->|\w\(|;\s*$|^\s*[#$>]\s", re.I | re.M)
_MATHS = re.compile(r"\\[A-Za-z]+|[\^_]\{|[\w)}][\^_]\w|[∑∫√≤≥≠±×÷]")
_STYLE = re.compile(r"[\w.#-]+\s*\{[^{}]*:[^{}]*\}|\b(?:window|document|dataLayer|gtag)\b|<!--|^\s*[\w.-]+:\s|\{\{|\\(?:documentclass|usepackage|begin|includegraphics|bibitem)")


def looks(leaf: Leaf) -> dict[str, str]:
    """What a block looks like, whatever its tags."""
    t = leaf.raw.strip("\n")
    n = max(1, len(t))
    lines = t.count("\n") + 1
    signs = sum(c in "{}();=<>[]_/\\|&$#\"'" for c in t) / n
    return {
        "size": str(min(len(leaf.text.strip()).bit_length(), 10)),
        "lines": "1" if lines == 1 else "2-4" if lines < 5 else "5-",
        "signs": str(sum(signs > x for x in (0.01, 0.04, 0.08, 0.15, 0.3))),
        "code": str(min(len(_CODE.findall(t)), 4)),
        "maths": str(min(len(_MATHS.findall(t)), 4)),
        "style": str(min(len(_STYLE.findall(t)), 3)),
        "bullet": str(bool(_BULLET.match(t))),
        "deep": str(bool(re.search(r"(?m)^(?: {2,}|\t)\S", t))),
        "mark": str(leaf.text.strip()[-1:] in ".!?。！？．।"),
        "stops": str(min(len(re.findall(r"[.!?。！？।](?:\s|$)|[。！？]", t)), 3)),
        "words": str(min(t.count(" "), 12)),
    }


def bare_features(before: dict[str, str], own: dict[str, str], after: dict[str, str]) -> tuple[str, ...]:
    """Features of a block whose tags say nothing: its looks and those of its neighbours."""
    one = [f"?{k}={v}" for k, v in own.items()]
    two = [f"?{a}={own[a]}&{b}={own[b]}" for a, b in (("size", "mark"), ("code", "signs"), ("maths", "code"), ("lines", "signs"), ("bullet", "size"), ("stops", "size"), ("style", "signs"), ("maths", "size"))]
    near = [f"?{side}{k}={x.get(k)}" for side, x in (("<", before), (">", after)) for k in ("size", "mark", "bullet")]
    return ("?bias", *one, *two, *near, f"?size={own['size']}>{after.get('size')}", f"?bullet={before.get('bullet')}{own['bullet']}{after.get('bullet')}")


def neutral(leaf: Leaf) -> bool:
    return all(t in NEUTRAL for t in leaf.path.split("/"))


def page_features(page: list[Leaf], bare: bool = False) -> list[tuple[str, ...]]:
    """Features of the blocks of a page; with ``bare``, as if it had no tags."""
    seen = [looks(x) if bare or any(map(neutral, page[max(0, k - 1) : k + 2])) else {} for k, x in enumerate(page)]
    return [bare_features(seen[k - 1] if k else {}, seen[k], seen[k + 1] if k + 1 < len(page) else {}) if bare or neutral(x) else features(x) for k, x in enumerate(page)]


def features(leaf: Leaf) -> tuple[str, ...]:
    """Features of a block whose tags say something."""
    tags = [re.sub(r"^h[1-6]$", "h", t) for t in leaf.path.split("/")]
    text = leaf.text.strip()
    n = len(text)
    inside = next((t for t in reversed(tags) if t in ("li", "nav", "script", "style", "pre", "h", "p", "item")), tags[-1])
    shape = "display" if _DISPLAY.match(text) else "blank" if not n else "text"
    return (
        "bias",
        f"tag={tags[-1]}",
        f"up={tags[-2] if len(tags) > 1 else ''}",
        f"root={tags[0]}",
        f"in={inside}",
        f"path={'/'.join(tags[-2:])}:{shape}",
        f"shape={shape}",
        f"tag={tags[-1]}:{shape}",
        f"nav={any('nav' in t for t in tags)}",
        f"long={min(n.bit_length(), 8)}",
        f"marks={text[-1:] in '.!?。！？．।'}",
    )


def teacher(leaf: Leaf) -> str:
    """The label of a block of a training page."""
    tags = leaf.path.split("/")
    last = tags[-1]
    if any("nav" in t for t in tags) or last in ("script", "style", "preamble", "definition", "table", "head", "title", "textarea", "template", "noscript", "comment", "front", "float") or any(t in ("head", "footer", "aside") for t in tags):
        return "drop"
    if "math" in last or last == "display" or _DISPLAY.match(leaf.text):
        return "formula"
    if last in ("pre", "code", "fence", "indented"):
        return "code"
    if re.fullmatch(r"h[1-6]?", last):
        return "heading"
    for t in reversed(tags):
        if t in ("li", "item", "dt"):
            return "item"
        if t in ("ul", "ol"):
            break
    return "para"


class Field:
    """Linear-chain conditional random field with binary features."""

    def __init__(self, names: list[str], weights: np.ndarray, moves: np.ndarray):
        self.index = {f: k for k, f in enumerate(names)}
        self.names, self.weights, self.moves = names, weights, moves
        self.memo: dict[tuple[str, ...], np.ndarray] = {}

    def scores(self, fs: tuple[str, ...]) -> np.ndarray:
        if fs not in self.memo:
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[fs] = self.weights[[self.index[f] for f in fs if f in self.index]].sum(0)
        return self.memo[fs]

    @classmethod
    def train(cls, pages: list[list[tuple[tuple[str, ...], int]]], epochs: int = 12, rate: float = 0.5, ridge: float = 1e-4) -> Field:
        names = sorted({f for p in pages for fs, _ in p for f in fs})
        index = {f: k for k, f in enumerate(names)}
        n = len(LABELS)
        w, m = np.zeros((len(names), n)), np.zeros((n, n))
        gw, gm = np.full_like(w, 1e-6), np.full_like(m, 1e-6)
        coded = []
        for p in filter(None, pages):
            rows = [[index[f] for f in fs] for fs, _ in p]
            width = np.array([len(r) for r in rows])
            coded.append((np.concatenate(rows), np.repeat(np.arange(len(rows)), width), np.cumsum(width) - width, np.array([y for _, y in p])))
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(coded)):
                flat, owner, starts, y = coded[k]
                one, two = marginals(np.add.reduceat(w[flat], starts), m)
                one[np.arange(len(y)), y] -= 1
                g = one[owner] + ridge * w[flat]
                np.add.at(gw, flat, g * g)
                np.subtract.at(w, flat, rate * g / np.sqrt(gw[flat]))
                for a, b in zip(y, y[1:]):
                    two[a, b] -= 1
                two += ridge * m
                gm += two * two
                m -= rate * two / np.sqrt(gm)
        return cls(names, w, m)

    def decode(self, page: list[tuple[str, ...]]) -> list[str]:
        """Viterbi."""
        if not page:
            return []
        best, back = self.scores(page[0]), []
        for fs in page[1:]:
            via = best[:, None] + self.moves
            back.append(via.argmax(0))
            best = via.max(0) + self.scores(fs)
        y = [int(best.argmax())]
        for b in reversed(back):
            y.append(int(b[y[-1]]))
        return [LABELS[k] for k in reversed(y)]


def marginals(e: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals of every block, and the expected number of every move, by forward-backward."""
    n = len(e)
    x, t = np.exp(e - e.max(1, keepdims=True)), np.exp(m - m.max())
    f, b = np.empty_like(x), np.ones_like(x)
    f[0] = x[0] / x[0].sum()
    for k in range(1, n):
        v = (f[k - 1] @ t) * x[k]
        f[k] = v / v.sum()
    two = np.zeros_like(m)
    for k in range(n - 1, 0, -1):
        v = x[k] * b[k]
        joint = f[k - 1][:, None] * t * v[None, :]
        two += joint / joint.sum()
        b[k - 1] = t @ v
        b[k - 1] /= b[k - 1].sum()
    one = f * b
    return one / one.sum(1, keepdims=True), two


def train(pages: DataFrame, sample: int = SAMPLE) -> Field:
    """A field of at most ``sample`` of the pages (column ``body``), those with the least hashes."""
    rows = pages.where(F.col("body") != "").select("body").orderBy(F.xxhash64("body")).limit(sample).toLocalIterator()
    return Field.train([x for r in rows for x in lessons(leaves(r["body"]))])


def lessons(page: list[Leaf]) -> Iterator[list[tuple[tuple[str, ...], int]]]:
    """A labelled page, as it is and without its tags, in stretches of at most STRETCH blocks, so that one endless page doesn't
    outweigh all others."""
    labels = [LABELS.index(teacher(x)) for x in page]
    for bare in (False, True):
        rows = [(f, y) for f, y, x in zip(page_features(page, bare), labels, page) if bare or not neutral(x)]
        for k in range(0, len(rows), STRETCH):
            yield rows[k : k + STRETCH]


def text_of(leaf: Leaf, label: str) -> str:
    if label in ("code", "formula"):
        m = _DISPLAY.match(leaf.raw)
        return squeezed(m["a"] or m["b"] if m and label == "formula" else leaf.raw)
    return squeezed(leaf.text)


def blocks(pages: DataFrame, key: str, field: Field | None = None) -> DataFrame:
    """pages(key, body) -> distinct (key, block_kind, block_text)."""
    field = field or train(pages)
    held = pages.sparkSession.sparkContext.broadcast((field.names, field.weights, field.moves))  # bounded by the sample
    kind = pages.schema[key].dataType.simpleString()

    def label(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Field(*held.value)
        for pdf in parts:
            rows = []
            for k, body in zip(pdf[key], pdf["body"]):
                page = leaves(body)
                for leaf, y in zip(page, own.decode(page_features(page))):
                    if y != "drop" and (t := text_of(leaf, y)):
                        rows.append((k, y, t))
            yield pd.DataFrame(list(dict.fromkeys(rows)), columns=[key, "block_kind", "block_text"])

    return pages.select(key, "body").mapInPandas(label, f"`{key}` {kind}, block_kind string, block_text string").distinct()
