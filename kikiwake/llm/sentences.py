"""Problem 1: sentence units in any of several languages and scripts, punctuated or not.

Method: a hidden-event n-gram language model. A block (the lines between two blank lines) is read as a stream of word, mark and gap
symbols in which boundary tokens are hidden; an interpolated trigram model (Witten-Bell) over the stream with its boundary tokens
gives, by the forward-backward algorithm, the posterior of a boundary at every gap; gaps of at least one half end a sentence.

The model is trained where it is used, on all texts: counts are made where the texts are and added up. Marks, quotations and block ends that leave no doubt label it. What they leave open - a full stop behind an abbreviation, an initial or
an ordinal - is relabelled by the model itself, round by round (hard expectation-maximization); the lists of abbreviations are only
where that begins. Words that stand before a full stop and a small letter more often than at the end of a block are taken for
abbreviations too, though no list has them. Symbols carry what a trigram could not see: whether a quotation that closes was opened
at the start of a sentence, whether a text sets closing marks at all, the script around a gap.

A second model of the same kind has the words themselves (characters of Thai, Chinese and Japanese) and was trained with all marks and
spaces left out. It decides in stretches without any mark that are longer than twice the longest sentence seen: there a
boundary may stand between any two words. It is counted over all texts too, but for the blocks with such stretches, and only for the
histories that these hold; without such stretches it isn't made. The longest sentence is the longest that a mark, or a gap of white
space, ends: one that only its block ends tells nothing. Where none is seen, nothing is split.

Edge cases: null, empty and blank texts have no units; very long texts are read block by block; an empty table trains an empty
model and gives no rows; repeated rows give repeated units; other columns aren't read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import persisted

ROUNDS, BLOCK_WORDS = 2, 100_000
SEP = "\x1f"  # white space, so no symbol or word has it
BOUNDARY = "<B>"
MARKS = "。！？!?.…।॥｡．‥⋯"
PAIRS = {"「": "」", "『": "』", "（": "）", "(": ")", "“": "”", "«": "»", "„": "“”", "《": "》", "【": "】", "〈": "〉", "[": "]", "［": "］", "〔": "〕", "‹": "›"}
CLOSERS = "".join(PAIRS.values())
QUOTES = "「『“«„《〈‹"
# Abbreviations that something must follow, abbreviations that may end a sentence, months, words that go on after a quotation.
OPEN_ABBREVIATIONS = set(
    "ej dr dra mr mrs ms prof sr sra srta mme mlle st ste fig figs sect sec no nos nr approx ca cf vs art p pp pág págs z b d h abb vgl bzw ff i.e e.g z.b d.h u.a vol eq ed eds ch kap nb núm tel abs ggf evtl inkl max min ver rev डॉ श्री "
    "hrn hr fr frau rd ref ex env chap tab tbl jan feb mar apr jun jul aug sep sept oct nov dec dez okt".split()
)
END_ABBREVIATIONS = set("etc usw a.m p.m inc co ltd jr u.s s.a bros corp".split())
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jänner".split())
GOES_ON = ("と", "って", "라고", "고 ", "随后", "यह कह", "यों कह", "ऐसा कह")

_BREAK = re.compile("\r\n|[\n\r\x85\u2028\u2029]")
_TOKEN = re.compile(f"([{re.escape(MARKS)}]+)|([{re.escape(''.join(PAIRS))}])|([{re.escape(CLOSERS)}])|(\\s+)")
_LETTERS = re.compile(r"[^\W\d_]+")
_LATIN = regex.compile(r"\p{Latin}")
_UNCASED = regex.compile(r"[\p{Hangul}\p{Devanagari}\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_TEXT = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Han}\p{Hiragana}\p{Katakana}ー]\p{M}*|[\p{L}\p{M}'’]+|\p{N}+")
_MAY_ABBREVIATE = re.compile(f"[.．｡][{re.escape(CLOSERS)}]*\\s*(?:[,、，;；:：)）]|[^\\W\\d_A-Z])")
_DOTS = re.compile(r"^(?:\.{2,}|[…‥⋯]+\.*|．{2,})$")


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the maximal runs of lines that hold more than white space, without outer white space."""
    at, start = 0, None
    for m in [*_BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        if text[at:end].strip():
            start = at if start is None else start
            last = end
        elif start is not None:
            yield _strip(text, start, last)
            start = None
        at = m.end() if m else end
    if start is not None:
        yield _strip(text, start, last)


def _strip(text: str, a: int, b: int) -> tuple[int, int]:
    while text[a].isspace():
        a += 1
    while text[b - 1].isspace():
        b -= 1
    return a, b


def script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or 0xFF10 <= o < 0xFF5B:
        return "num" if c.isdigit() else "la" if c.isalpha() else "sym"
    if 0x3041 <= o <= 0x30FF:
        return "kana"
    if 0x3400 <= o <= 0x9FFF or 0xF900 <= o < 0xFB00 or 0x20000 <= o < 0x30000 or o == 0x3005:
        return "han"
    if 0xAC00 <= o < 0xD7A4:
        return "hangul"
    if 0x0E00 <= o < 0x0E80:
        return "thai"
    if 0x0900 <= o < 0x0980:
        return "deva"
    return "letter" if c.isalpha() else "mark" if unicodedata.category(c)[0] == "M" else "sym"


def unmarked(text: str, spans: list[tuple[int, int]]) -> str:
    """"th" or "cjk" for a text of that script that sets no closing marks, else "". Marks inside brackets and pauses don't count."""
    n = Counter(script(c) for c in text)
    kind = "th" if n["thai"] > max(n["la"], n["han"] + n["kana"], n["hangul"], n["deva"]) else "cjk" if n["kana"] + n["han"] > max(n["la"], n["hangul"], n["thai"]) else ""
    if not kind:
        return ""
    if kind == "th":
        return "th"
    long = marked = 0
    for a, b in spans:
        if b - a >= 15:
            long += 1
            end = text[b - 1]
            marked += end in MARKS or end in CLOSERS and text[b - 2] in MARKS and _opens_at(text, a, b) == a
    return kind if long and marked < 0.5 * long else ""


def _opens_at(text: str, a: int, b: int) -> int:
    close, depth = text[b - 1], 0
    for k in range(b - 1, a - 1, -1):
        c = text[k]
        depth += (c == close) - (c in PAIRS and close in PAIRS[c])
        if depth == 0:
            return k
    return -1


def _matched(s: str) -> dict[int, int]:
    """Opening and closing positions of brackets and quotations that match within a block."""
    stack: list[int] = []
    opened: Counter[str] = Counter()
    out: dict[int, int] = {}
    for k, c in enumerate(s):
        if c in "”“" and stack and s[stack[-1]] == "„" or c not in PAIRS and c in CLOSERS:
            # what can't be closed is seen by the count of open marks, else each stray mark would search the whole stack
            for back in range(len(stack) - 1, -1, -1) if any(c in PAIRS[o] for o in opened if opened[o]) else ():
                if c in PAIRS[s[stack[back]]]:
                    out[stack[back]], out[k] = k, stack[back]
                    opened.subtract(s[i] for i in stack[back:])
                    del stack[back:]
                    break
        elif c in PAIRS:
            stack.append(k)
            opened[c] += 1
    return out


class Gap:
    __slots__ = ("after", "before", "boundary", "end", "mark", "open", "word")

    def __init__(self, end: int, before: str, mark: str, after: str, boundary: bool, word: str = "", doubt: bool = False):
        """boundary is the seed's opinion; open means that it is no more than where training begins."""
        self.end, self.before, self.mark, self.after, self.boundary, self.word, self.open = end, before, mark, after, boundary, word, doubt


def _word(s: str, k: int) -> str:
    """The word before k; of a script without spaces no more than one character."""
    a = k
    while a and not s[a - 1].isspace() and s[a - 1] not in "(（「『“«„[¿¡":
        a -= 1
        if script(s[a]) in ("han", "kana", "thai"):
            break
    return s[a:k]


def _before(w: str, known: frozenset[str]) -> str:
    """Symbol of the word before a mark; known: abbreviations beside the listed ones."""
    low = w.lower().rstrip(".")
    if low in OPEN_ABBREVIATIONS or low in END_ABBREVIATIONS or low in known:
        return "w=" + low
    if not w:
        return "none"
    if w.isdigit():
        return "num12" if len(w) <= 2 else "num"
    if len(low) == 1 and w[0].isalpha() and script(w[0]) == "la":
        return "initial"
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", w):
        return "dotted"
    return script(w[-1]) + ("" if script(w[-1]) != "la" else "U" if w[0].isupper() else "l")


def _after(s: str, k: int) -> str:
    """Symbol of what follows a gap: spacing, and the class of the next character or word."""
    m = k
    while m < len(s) and s[m].isspace():
        m += 1
    space = "_" if m > k else ""
    if m == len(s):
        return "end"
    if s.startswith(GOES_ON, m):
        return space + "goes-on"
    c = s[m]
    if c in ",、，;；:：)）":
        return space + "pause"
    if c in PAIRS or c in "¿¡\"'‘":
        return space + "open"
    if c in MARKS:
        return space + "mark"
    kind = script(c)
    if kind == "la":
        w = _LETTERS.match(s, m)[0].lower()
        return space + ("month" if w in MONTHS else "low" if c.islower() else "Up")
    return space + kind


def gaps(s: str, style: str, known: frozenset[str] = frozenset()) -> list[Gap]:
    """The gaps of a block at which a boundary may hide, with their symbols and the seed's opinion."""
    pairs, out, depth, last = _matched(s), [], 0, 0
    latin, uncased_at = ([m.start() for m in x.finditer(s)] if any(c in CLOSERS for c in s) else [] for x in (_LATIN, _UNCASED))
    full: list[bool] = []
    for m in _TOKEN.finditer(s):
        a, b = m.span()
        if m[4]:
            if style and depth == 0 and b < len(s):
                left, right = script(s[a - 1]), script(s[b])
                if style == "th":
                    line = "nl" if _BREAK.search(m[4]) else ""
                    latin = "la" if left in ("la", "num") or right in ("la", "num") else ""
                    sym, is_end = f"sp:th{latin}{line}", not latin
                else:
                    line, latin = _BREAK.search(m[4]), left in ("la", "num") or right in ("la", "num")
                    sym, is_end = f"sp:cjk{'wide' if '　' in m[4] else ''}{'la' if latin else ''}{'nl' if line else ''}", not line and ("　" in m[4] or not latin)
                if s[a - 1] in MARKS and out and out[-1].end == a:
                    continue
                out.append(Gap(a, left, sym, _after(s, b), is_end))
                last = b if is_end else last
            continue
        if m[2] and a in pairs and pairs[a] > a:
            full.append(depth == 0 and not s[last:a].strip())
            depth += 1
            continue
        if a in pairs and pairs[a] < a:
            depth = max(0, depth - 1)
            whole = full.pop() if full else False
            inner = s[:a].rstrip()
            if depth == 0 and inner and inner[-1] in MARKS:
                after = _after(s, b)
                kind = "q" if s[pairs[a]] in QUOTES else "p"
                t = inner.rstrip(MARKS).rstrip()
                cased = bool(t) and script(t[-1]) in ("la", "num") and bisect_left(latin, a) >= bisect_left(uncased_at, a)
                ends = whole and after.lstrip("_") not in ("goes-on", "pause", "mark") and not (after.lstrip("_") == "low" and cased)
                out.append(Gap(b, "la" if cased else "uncased", f"{inner[-1]}{kind}{'full' if whole else 'mid'}", after, ends))
                if ends:
                    last = b
            elif depth == 0 and whole and style == "" and a + 1 == len(s):
                last = b
            continue
        if not m[1] or depth:
            continue
        run = m[1]
        w = _word(s, a)
        k = a
        while k > 1 and unicodedata.category(s[k - 1]) == "So":  # a pictograph that got into a word
            k -= 1
        w = _word(s, k) if k < a else w
        prev, nxt = s[k - 1] if k else "", s[b] if b < len(s) else ""
        if run in (".", "．") and prev and nxt and script(prev) in ("la", "num") and script(nxt) in ("la", "num"):
            glued = script(nxt) == "la" and nxt.isupper() and (prev.islower() or prev.isdigit()) and s[b + 1 : b + 2].islower() and len(w) > 2 and "." not in w
            if not glued:
                continue
        while b < len(s) and s[b] in CLOSERS and b not in pairs:
            b += 1
        before, after, doubt = _before(w, known), _after(s, b), False
        cls = after.lstrip("_")
        uncased = bool(prev) and script(s[:a].rstrip()[-1:] or " ") not in ("la", "num", "sym")
        if _DOTS.match(run):
            first = not re.search(r"\s", s[last:a].strip())
            sym = f"dots{'first' if first else ''}{'uncased' if uncased else ''}"
            ends = cls == "end" or not first and not uncased and cls in ("Up", "open") and bool(prev) and not prev.isspace()
            if prev.isspace():
                sym += "_"
        elif run in (".", "．", "｡") or run[0] in "." and len(run) == 1:
            sym = f".{'uncased' if uncased else ''}"
            doubt = (before.startswith("w=") or before in ("initial", "dotted")) and cls not in ("low", "pause", "mark", "end") or before == "num12" and cls == "month"
            if before.startswith("w="):
                ends = before[2:] not in OPEN_ABBREVIATIONS and cls not in ("low", "pause", "mark", "month")
            elif before in ("initial", "dotted"):
                ends = cls == "end"
            elif before == "num12" and cls == "month":
                ends = False
            else:
                ends = cls not in ("pause", "mark") and (cls != "low" or uncased)
        else:
            sym = f"{run[0]}{'uncased' if uncased or run[0] in '。।！？' else ''}"
            ends = cls not in ("pause", "mark") and (cls != "low" or "uncased" in sym)
        out.append(Gap(b, before, sym, after, ends, w.lower().rstrip(".") if sym == "." else "", doubt))
        if ends:
            last = b
    return [g for g in out if g.end < len(s)]


def stream(s: str, style: str, known: frozenset[str] = frozenset()) -> tuple[list[str], list[int], list[Gap]]:
    """Symbols of a block and, per gap, the index of the symbol it stands behind."""
    symbols, at, found = ["<s>"], [], gaps(s, style, known)
    for g in found:
        symbols += [g.before, g.mark]
        at.append(len(symbols) - 1)
        symbols.append(g.after)
    symbols.append("</s>")
    return symbols, at, found


def with_boundaries(symbols: list[str], ends: set[int]) -> list[str]:
    out: list[str] = []
    for k, x in enumerate(symbols):
        out.append(x)
        if k in ends:
            out.append(BOUNDARY)
    return out


def grams(x: list[str]) -> Iterator[tuple[str, ...]]:
    for k in range(len(x)):
        for n in (1, 2, 3):
            if k + 1 >= n:
                yield tuple(x[k + 1 - n : k + 1])


class EventModel:
    """Interpolated trigram model over symbols and boundary tokens; kinds[h] is the number of symbols seen after history h."""

    def __init__(self, counts: Counter, known: frozenset[str] = frozenset()):
        self.counts, self.known = counts, known
        self.total: Counter = Counter()
        self.kinds: Counter = Counter()
        for g, n in counts.items():
            self.total[g[:-1]] += n
            self.kinds[g[:-1]] += 1
        self.size = max(1, self.kinds[()]) + 1
        self.memo: dict[tuple[str, ...], float] = {}

    @classmethod
    def train(cls, streams: Iterable[list[str]], known: frozenset[str] = frozenset()) -> EventModel:
        counts: Counter = Counter()
        for x in streams:
            counts.update(grams(x))
        return cls(counts, known)

    def p(self, *g: str) -> float:
        if g in self.memo:
            return self.memo[g]
        lower = self.p(*g[1:]) if len(g) > 1 else 1 / self.size
        h = g[:-1]
        t = self.kinds[h]
        v = (self.counts[g] + t * lower) / (self.total[h] + t) if t else lower
        if len(self.memo) > 1_000_000:
            self.memo.clear()
        self.memo[g] = v
        return v

    def posteriors(self, symbols: list[str], at: list[int]) -> list[float]:
        """Probability of a boundary behind each symbol of ``at``: forward-backward over the two states "a boundary stands before
        this symbol" and "none does"."""
        may = set(at)
        n = len(symbols)

        def step(k: int, before: int, now: int) -> float:
            """From symbol k - 1, in state ``before``, to symbol k, in state ``now``."""
            h1 = symbols[k - 1]
            h2 = BOUNDARY if before else symbols[k - 2] if k > 1 else None
            h = (h1,) if h2 is None else (h2, h1)
            if not now:
                return self.p(*h, symbols[k])
            return self.p(*h, BOUNDARY) * self.p(h1, BOUNDARY, symbols[k]) if k - 1 in may else 0.0

        forward = [(1.0, 0.0)]
        for k in range(1, n):
            f0, f1 = forward[-1]
            a = f0 * step(k, 0, 0) + (f1 * step(k, 1, 0) if f1 else 0.0)
            b = (f0 * step(k, 0, 1) + (f1 * step(k, 1, 1) if f1 else 0.0)) if k - 1 in may else 0.0
            z = a + b
            forward.append((a / z, b / z))
        backward = [(1.0, 1.0)] * n
        for k in range(n - 2, -1, -1):
            g0, g1 = backward[k + 1]
            one = k in may
            v = [step(k + 1, s, 0) * g0 + (step(k + 1, s, 1) * g1 if one else 0.0) for s in (0, 1)]
            z = max(v) or 1.0
            backward[k] = (v[0] / z, v[1] / z)
        out = []
        for k in at:
            a, b = (forward[k + 1][s] * backward[k + 1][s] for s in (0, 1))
            out.append(b / (a + b) if a + b else 0.0)
        return out


def streams(text: str, known: frozenset[str] = frozenset()) -> Iterator[tuple[list[str], list[int], list[Gap]]]:
    """``stream`` of every block of a text."""
    spans = list(blocks(text))
    style = unmarked(text, spans)
    for a, b in spans:
        yield stream(text[a:b], style, known)


def seed_streams(text: str, known: frozenset[str] = frozenset()) -> Iterator[list[str]]:
    """Training streams of a text, with boundary tokens where the seed sees them."""
    for symbols, at, found in streams(text, known):
        yield with_boundaries(symbols, {k for k, g in zip(at, found) if g.boundary})


def _before_dots(text: str, inside: Counter, at_end: Counter) -> None:
    """Counts of the words before full stops, with a small letter or a pause behind, and at the ends of blocks."""
    if _MAY_ABBREVIATE.search(text):
        for _, _, found in streams(text):
            inside.update(g.word for g in found if g.word.isalpha() and g.after.lstrip("_") in ("low", "pause"))
    at_end.update(_word(text, b - 1).lower() for _, b in blocks(text) if text[b - 1] == ".")


def learn(texts: list[str], rounds: int = ROUNDS) -> EventModel:
    """An event model of texts: abbreviations first, then the seed's labels, then those of the model where the seed is in doubt."""
    parsed = [x for t in texts for x in streams(t)]
    inside, at_end = Counter(), Counter()
    for text in texts:
        _before_dots(text, inside, at_end)
    known = frozenset(w for w, n in inside.items() if n >= 2 and n > at_end[w] and w not in OPEN_ABBREVIATIONS and w not in END_ABBREVIATIONS)
    if known:
        parsed = [x for t in texts for x in streams(t, known)]
    labels = [{k for k, g in zip(at, found) if g.boundary and not (g.open and g.before[2:] in known)} for _, at, found in parsed]
    model = EventModel.train((with_boundaries(x[0], ends) for x, ends in zip(parsed, labels)), known)
    for _ in range(rounds):
        for n, (symbols, at, found) in enumerate(parsed):
            if any(g.open for g in found):
                labels[n] = {k for k, g, p in zip(at, found, model.posteriors(symbols, at)) if (p >= 0.5 if g.open else g.boundary)}
        model = EventModel.train((with_boundaries(x[0], ends) for x, ends in zip(parsed, labels)), known)
    return model


class WordModel:
    """Boundaries between any two words, from the words alone. longest: words of the longest sentence seen."""

    def __init__(self, counts: Counter, longest: int):
        self.model, self.longest = EventModel(counts), longest

    @staticmethod
    def tokens(s: str) -> list[tuple[str, int, int]]:
        return [("<num>" if m[0].isnumeric() else m[0].lower(), *m.span()) for m in _TEXT.finditer(s)]

    @classmethod
    def learn(cls, texts: Iterable[str], model: EventModel) -> WordModel:
        texts = list(texts)
        longest = max((len(cls.tokens(t[x:y])) for t in texts for x, y, told in told_units(t, model) if told), default=0)
        return cls(EventModel.train(x for t in texts for x in cls.streams(t, model, longest)).counts, longest)

    @classmethod
    def streams(cls, text: str, model: EventModel, longest: int) -> Iterator[list[str]]:
        """Training streams of a text, one a block, without the blocks that hold a stretch to be split."""
        spans, out, at, skip = list(blocks(text)), ["<s>"], 0, False
        for x, y in units(text, model):
            while x >= spans[at][1]:
                if not skip:
                    yield [*out, "</s>"]
                out, at, skip = ["<s>"], at + 1, False
            words = [w for w, *_ in cls.tokens(text[x:y])]
            skip = skip or stretch(text[x:y], len(words), longest)
            out += [*words, BOUNDARY] if words else []
        if spans and not skip:
            yield [*out, "</s>"]

    def cut(self, s: str, threshold: float = 0.5) -> list[int]:
        """Positions behind words at which a sentence ends, none inside brackets or quotations."""
        words = self.tokens(s)
        if len(words) < 2:
            return []
        symbols = ["<s>", *(w for w, *_ in words), BOUNDARY, "</s>"]
        pairs = sorted((a, b) for a, b in _matched(s).items() if a < b)
        free, k, inside = [], 0, -1
        for n, (_, _, end) in enumerate(words[:-1], 1):
            while k < len(pairs) and pairs[k][0] < end:
                inside = max(inside, pairs[k][1])
                k += 1
            if end > inside:
                free.append(n)
        return [words[n - 1][2] for n, p in zip(free, self.model.posteriors(symbols, free)) if p >= threshold]


def stretch(part: str, words: int, longest: int) -> bool:
    """Whether a unit is to be split by its words."""
    return 0 < 2 * longest < words and not any(c in MARKS for c in part[:-1])


def told_units(text: str, model: EventModel) -> Iterator[tuple[int, int, bool]]:
    """Units, and whether a mark or a gap ends each, and not its block alone."""
    ends = {b for _, b in blocks(text)} if text else set()
    for x, y in units(text, model):
        yield x, y, y not in ends or text[y - 1] in MARKS or text[y - 1] in CLOSERS


def split(part: str, cuts: list[int]) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces of a part that is cut at some positions."""
    start = 0
    for end in [*cuts, len(part)]:
        if part[start:end].strip():
            yield _strip(part, start, end)
        start = end


def units(text: str | None, model: EventModel, words: WordModel | None = None, threshold: float = 0.5) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentence units of a text."""
    if not text:
        return
    spans = list(blocks(text))
    style = unmarked(text, spans)
    for a, b in spans:
        s = text[a:b]
        symbols, at, found = stream(s, style, model.known)
        ends = [g.end for g, p in zip(found, model.posteriors(symbols, at) if found else ()) if p >= threshold]
        start = 0
        for end in [*ends, len(s)]:
            part = s[start:end]
            if not part.strip():
                continue
            cuts = words.cut(part) if words and end - start > 2 * words.longest and stretch(part, len(words.tokens(part)), words.longest) else []
            for x, y in split(part, cuts):
                yield a + start + x, a + start + y
            start = end


def _table(columns: dict[str, list], **kinds: str) -> pd.DataFrame:
    """Columns of Python's own strings, which may be empty, and of the kinds named."""
    return pd.DataFrame({c: pd.Series(v, dtype=kinds.get(c, "object")) for c, v in columns.items()})


def train(texts: DataFrame) -> EventModel:
    """``learn`` over all texts (column ``text``). What reaches the driver: abbreviations, and n-grams of symbols, of which there are few."""
    text = texts.where("text <> ''").select("text")

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            inside, at_end = Counter(), Counter()
            for t in pdf["text"]:
                _before_dots(t, inside, at_end)
            words = [*inside.keys() | at_end.keys()]
            yield _table({"word": words, "inside": [inside[w] for w in words], "at_end": [at_end[w] for w in words]}, inside="int64", at_end="int64")

    seen = text.mapInPandas(look, "word string, inside bigint, at_end bigint").groupBy("word").agg(F.sum("inside").alias("inside"), F.sum("at_end").alias("at_end"))
    known = frozenset(r["word"] for r in seen.where("inside >= 2 and inside > at_end").collect()) - OPEN_ABBREVIATIONS - END_ABBREVIATIONS

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """n-grams of the blocks whose labels stay, and the other blocks themselves."""
        for pdf in parts:
            counts, others = Counter(), Counter()
            for symbols, at, found in (x for t in pdf["text"] for x in streams(t, known)):
                seed = [int(g.boundary and not (g.open and g.before[2:] in known)) for g in found]
                if any(g.open for g in found):
                    others[json.dumps([symbols, at, seed, [int(g.open) for g in found]])] += 1
                else:
                    counts.update(grams(with_boundaries(symbols, {k for k, e in zip(at, seed) if e})))
            yield _table({"open": [False] * len(counts) + [True] * len(others), "g": [*map(SEP.join, counts), *others], "n": [*counts.values(), *others.values()]}, open="bool", n="int64")

    parsed = persisted(text.mapInPandas(parse, "open boolean, g string, n bigint").groupBy("open", "g").agg(F.sum("n").alias("n")), "parsed")
    closed = Counter({tuple(r["g"].split(SEP)): r["n"] for r in parsed.where("not open").collect()})
    model = None
    for _ in range(ROUNDS + 1):
        held = text.sparkSession.sparkContext.broadcast(dict(model.counts) if model else None)

        def label(parts: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            m = EventModel(Counter(held.value), known) if held.value is not None else None
            for pdf in parts:
                counts: Counter = Counter()
                for g, n in zip(pdf["g"], pdf["n"]):
                    symbols, at, seed, opened = json.loads(g)
                    ends = [p >= 0.5 if o else e for p, o, e in zip(m.posteriors(symbols, at), opened, seed)] if m else seed
                    for x in grams(with_boundaries(symbols, {k for k, e in zip(at, ends) if e})):
                        counts[x] += int(n)
                yield _table({"g": [*map(SEP.join, counts)], "n": [*counts.values()]}, n="int64")

        rows = parsed.where("open").mapInPandas(label, "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect()
        model = EventModel(closed + Counter({tuple(r["g"].split(SEP)): r["n"] for r in rows}), known)
        if not rows:
            break
    return model


class _Counted(EventModel):
    """A model of the n-grams, and histories, that some stretches ask for."""

    def __init__(self, rows: pd.DataFrame):
        self.counts, self.total, self.kinds, self.memo = Counter(), Counter(), Counter(), {}
        for h, x, n, total, kinds in zip(rows["h"], rows["x"], rows["n"], rows["total"], rows["kinds"]):
            history = tuple(h.split(SEP)) if h else ()
            self.counts[(*history, x)], self.total[history], self.kinds[history] = int(n), int(total), int(kinds)
        self.size = max(1, self.kinds[()]) + 1


def _asked(part: str) -> set[tuple[str, ...]]:
    """The n-grams that the posteriors of a stretch may ask for."""
    x = ["<s>", *(w for w, *_ in WordModel.tokens(part)), BOUNDARY, "</s>"]
    full = {(b, h, y) for k in range(1, len(x)) for b in (x[k - 2] if k > 1 else BOUNDARY, BOUNDARY) for h in (x[k - 1],) for y in (x[k], BOUNDARY)} | {(h, BOUNDARY, y) for h, y in zip(x, x[1:])}
    return {g[k:] for g in full for k in range(3)}


def _split_stretches(texts: DataFrame, found: DataFrame, key: str, kind: str, model: EventModel, longest: int, words: int) -> DataFrame:
    """found(key, start_pos, end_pos, part) of the stretches, of that many words, split by a model of the words of all texts. Blocks of
    stretches meet the counts that they ask for, so neither is held as a whole."""
    held = texts.sparkSession.sparkContext.broadcast((dict(model.counts), model.known))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = EventModel(Counter(held.value[0]), held.value[1])
        for pdf in parts:
            counts = Counter(g for t in pdf["text"] if t for x in WordModel.streams(t, m, longest) for g in grams(x))
            yield _table({"h": [SEP.join(g[:-1]) for g in counts], "x": [g[-1] for g in counts], "n": [*counts.values()]}, n="int64")

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = list({(int(b), SEP.join(g[:-1]), g[-1]) for b, part in zip(pdf["block"], pdf["part"]) for g in _asked(part)})
            yield _table({"block": [r[0] for r in rows], "h": [r[1] for r in rows], "x": [r[2] for r in rows]}, block="int32")

    def cut(stretches: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        w = WordModel(Counter(), longest)
        w.model = _Counted(rows)
        out = [(k, a + x, a + y) for k, a, part in zip(stretches[key], stretches["start_pos"], stretches["part"]) for x, y in split(part, w.cut(part))]
        return pd.DataFrame(out, columns=[key, "start_pos", "end_pos"])

    blocked = found.withColumn("block", F.pmod(F.xxhash64(key, "start_pos"), F.lit(-(-words // BLOCK_WORDS))).cast("int"))
    asked = persisted(blocked.select("block", "part").mapInPandas(ask, "block int, h string, x string").distinct(), "asked")
    counts = texts.select("text").mapInPandas(count, "h string, x string, n bigint").join(asked.select("h").distinct(), "h", "left_semi")
    counts = persisted(counts.groupBy("h", "x").agg(F.sum("n").alias("n")), "counts")
    totals = counts.groupBy("h").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    rows = asked.join(totals, "h").join(counts, ["h", "x"], "left").select("block", "h", "x", F.coalesce("n", F.lit(0)).alias("n"), "total", "kinds")
    return blocked.select("block", key, "start_pos", "part").groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(cut, f"`{key}` {kind}, start_pos int, end_pos int")


def sentences(texts: DataFrame, key: str) -> DataFrame:
    """texts(key, text) -> (key, start_pos, end_pos) of every sentence unit."""
    texts = texts.select(key, "text")
    model, kind = train(texts), texts.schema[key].dataType.simpleString()
    held = texts.sparkSession.sparkContext.broadcast((dict(model.counts), model.known))

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Units; words are counted where a unit may be the longest or a stretch, which no shorter one than the longest so far can be."""
        m, longest = EventModel(Counter(held.value[0]), held.value[1]), 0
        for pdf in parts:
            rows = []
            for k, t in zip(pdf[key], pdf["text"]):
                for x, y, told in told_units(t, m):
                    n = len(WordModel.tokens(t[x:y])) if y - x > longest else 0
                    longest = max(longest, n) if told else longest
                    rows.append((k, x, y, n, told, t[x:y] if n > 2 * longest else None))
            found = pd.DataFrame(rows, columns=[key, "start_pos", "end_pos", "words", "told", "part"])
            yield found.astype({"part": object})

    found = persisted(texts.mapInPandas(cut, f"`{key}` {kind}, start_pos int, end_pos int, words int, told boolean, part string"), "units")
    longest = found.where("told").agg(F.max("words")).first()[0] or 0
    marks = F.col("part").substr(F.lit(1), F.length("part") - 1).rlike(f"[{re.escape(MARKS)}]")
    long = F.coalesce((F.lit(longest) > 0) & (F.col("words") > 2 * longest) & ~marks, F.lit(False))
    stretches = found.where(long)
    words = stretches.agg(F.sum("words")).first()[0]
    if not words:
        return found.select(key, "start_pos", "end_pos")
    pieces = _split_stretches(texts, stretches.select(key, "start_pos", "end_pos", "part"), key, kind, model, longest, words)
    return found.where(~long).select(key, "start_pos", "end_pos").unionByName(pieces)
