"""A tokenizer by least cost: of all ways to cut a text into words of a lexicon and unknown runs, the cheapest one.

A word costs what the lexicon says. Where none begins, or beside those that do, an unknown token may stand: the characters of one kind
(katakana, letters, digits, one character of any other kind) at ``UNKNOWN`` plus ``EACH`` a character. Ties go to fewer tokens, then to
the cut whose first difference is the longer token. White space parts tokens and is none.

Method: without words the cut is known, a token for each run of one kind; runs are found for many texts at a time with numpy. Where a word
begins at a place that a cut reaches, all ways from there to the next place that all of them reach are weighed, and only those.

Edge cases: null gives null, "" and blanks give no tokens; equal surfaces in the lexicon count once, at the least cost (ties: the
least reading); a text of any length takes time in proportion to it and to the longest word. Texts are cut ``CHARS`` characters at a
time, whole texts each, and tokens go out as Arrow arrays: memory grows with the longest text, not with the number of texts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import TOKENS

UNKNOWN, EACH, NOUN = 10.0, 2.0, "名詞"
CHARS = 1 << 18
KINDS, SPACE = ("", "kata", "digit", "letter"), 4


def kind(c: str) -> str:
    o = ord(c)
    if 0x30A1 <= o <= 0x30FC:
        return "kata"
    if c.isdigit():
        return "digit"
    return "letter" if c.isascii() and c.isalpha() else ""


@lru_cache(maxsize=1)
def _kind_of() -> np.ndarray:
    """The kind of every code point, as its place in KINDS; SPACE for white space."""
    return np.array([SPACE if chr(c).isspace() else KINDS.index(kind(chr(c))) for c in range(sys.maxunicode + 1)], np.uint8)


class Words:
    """Words by surface, and what tells quickly that none begins at a place."""

    def __init__(self, words: dict[str, tuple[float, str]]):
        self.words = words
        self.lengths: dict[str, tuple[int, ...]] = {}  # of the words that begin with a character
        for w in sorted(words, key=len):
            if w and len(w) not in (held := self.lengths.get(w[0], ())):
                self.lengths[w[0]] = (*held, len(w))
        self.pairs = np.unique(np.array([_pair(ord(w[0]), ord(w[1])) for w in words if len(w) > 1], np.int64))
        self.alone = np.unique(np.array([ord(w) for w in words if len(w) == 1], np.uint32))

    def at(self, s: str, k: int, end: int) -> list[int]:
        """Lengths of the words that begin at k and end in the text, which ends at ``end``."""
        return [m for m in self.lengths.get(s[k], ()) if k + m <= end and s[k : k + m] in self.words]

    def may_begin(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the places, those at which a word may begin, by its first two characters."""
        two = _pair(codes[at].astype(np.int64), codes[np.minimum(at + 1, len(codes) - 1)].astype(np.int64))
        return at[np.isin(two, self.pairs) | np.isin(codes[at], self.alone)]


def _pair(a: int | np.ndarray, b: int | np.ndarray) -> int | np.ndarray:
    return a << 21 | b


def cuts(s: str, ends: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and whether they are known, of the tokens of the texts in s. Each text ends at one of ``ends`` with white space
    after it, or at the end of s."""
    codes = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    kinds = _kind_of()[codes]
    edge = np.ones(len(s) + 1, bool)  # a run, or white space, begins
    edge[1:-1] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 0)
    edges = np.flatnonzero(edge)
    own = kinds[edges[:-1]] != SPACE
    start, stop = edges[:-1][own], edges[1:][own]
    from_, to, tokens, k = [], [], [], 0
    for p in words.may_begin(codes, start).tolist():
        if p < k:
            continue
        end = int(ends[np.searchsorted(ends, p, "right")])
        if words.at(s, p, end):
            k = _weigh(s, p, end, words, kinds, edge, tokens)
            from_.append(p)
            to.append(k)
    known = np.zeros(len(start), bool)
    if tokens:
        lo, hi = np.searchsorted(start, from_), np.searchsorted(start, to)
        inside = np.zeros(len(start) + 1, np.int64)
        np.add.at(inside, lo, 1)
        np.add.at(inside, hi, -1)
        free = np.cumsum(inside[:-1]) == 0
        a, b, is_word = (np.array(x) for x in zip(*tokens))
        start, stop, known = np.concatenate([start[free], a]), np.concatenate([stop[free], b]), np.concatenate([known[free], is_word])
        o = np.argsort(start, kind="stable")
        start, stop, known = start[o], stop[o], known[o]
    return start, stop, known


def _weigh(s: str, p: int, end: int, words: Words, kinds: np.ndarray, edge: np.ndarray, out: list[tuple[int, int, bool]]) -> int:
    """Add the tokens from p up to the next place, an edge, that all ways from p reach; that place. Best costs are worked out from the
    end, so that ties are settled from the start."""
    options: dict[int, list[tuple[int, bool]]] = {}
    ahead = {p}
    while True:
        k = min(ahead)
        if len(ahead) == 1 and k != p and edge[k] or k >= end:
            break
        ahead.remove(k)
        if kinds[k] == SPACE:
            options[k] = []
            ahead.add(k + 1)
            continue
        e = k + 1
        while not edge[e]:
            e += 1
        options[k] = [*((k + m, True) for m in words.at(s, k, end)), (e, False)]
        ahead.update(x for x, _ in options[k])
    best: dict[int, tuple[float, int]] = {k: (0.0, 0)}
    step: dict[int, tuple[int, bool]] = {}
    for j in reversed(options):
        if not options[j]:
            best[j], step[j] = best[j + 1], (j + 1, False)
            continue
        choice = None
        for x, known in options[j]:
            rest, tokens = best[x]
            key = (rest + (words.words[s[j:x]][0] if known else UNKNOWN + EACH * (x - j)), tokens + 1, j - x, not known)
            if choice is None or key < choice[0]:
                choice = key, x, known
        best[j], step[j] = choice[0][:2], choice[1:]
    j = p
    while j < k:
        x, known = step[j]
        if options[j]:
            out.append((j, x, known))
        j = x
    return k


def cut(s: str, words: dict[str, tuple[float, str]], longest: int) -> list[tuple[int, int, bool]]:
    """(start, end, known) of the tokens of one text, by words of at most ``longest`` characters."""
    start, stop, known = cuts(s, np.array([len(s)]), Words({w: x for w, x in words.items() if len(w) <= longest}))
    return list(zip(start.tolist(), stop.tolist(), known.tolist()))


def _texts(codes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    data = codes.tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def _records(texts: list[str | None], words: Words) -> pa.Array:
    """Tokens of texts, as an array of lists."""
    s = "\n".join(t or "" for t in texts)
    ends = np.cumsum([len(t or "") + 1 for t in texts]) - 1
    start, stop, known = cuts(s, ends, words)
    codes = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    kept = _kind_of()[codes] != SPACE
    surfaces = [s[a:b] for a, b in zip(start[known].tolist(), stop[known].tolist())]
    for a, w in zip(start[known].tolist(), surfaces):
        kept[a : a + len(w)] = True  # words may have spaces
    codes = codes[kept]
    width = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF))])
    offsets = width[np.concatenate([[0], np.cumsum(stop - start)])]
    hiragana = (codes >= 0x3041) & (codes <= 0x3096)
    readings = _texts(np.where(hiragana, codes + np.uint32(0x60), codes), offsets)  # as wide as hiragana
    is_known = pa.array(known)
    if surfaces:
        readings = pc.replace_with_mask(readings, is_known, pa.array([words.words[w][1] for w in surfaces], pa.string()))
    fields = [_texts(codes, offsets), readings, pc.if_else(is_known, NOUN, "*")]
    first = np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays(fields, ["surface", "reading", "pos"]), mask=pa.array([t is None for t in texts]))


def batches(texts: list[str | None], chars: int) -> Iterator[list[str | None]]:
    """The texts in their order, some at a time: of at most ``chars`` characters, or one."""
    part, size = [], 0
    for t in texts:
        n = len(t or "") + 1
        if part and size + n > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += n
    if part:
        yield part


def token_arrays(parts: Iterator[pa.Array], words: dict[str, tuple[float, str]]) -> Iterator[pa.Array]:
    """Texts to lists of tokens, in more and smaller arrays than come in."""
    quick = Words(words)
    for arr in parts:
        for texts in batches(arr.to_pylist(), CHARS):
            yield _records(texts, quick)


def lattice_tokens(c: Column, lexicon: list[tuple[str, str, float]]) -> Column:
    """Tokens of a text by a lexicon of (surface, reading, cost), which goes out with the function: a word list, not a table."""
    words: dict[str, tuple[float, str]] = {}
    for surface, reading, cost in lexicon:
        if surface and (surface not in words or (cost, reading) < words[surface]):
            words[surface] = (cost, reading)

    @F.arrow_udf(TOKENS)
    def tokens(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return token_arrays(parts, words)

    return tokens(c)
