"""Problem 4: one canonical form for text that looks the same but differs in its characters.

Method: normalization quick-check properties isolate the unstable segments of a string. A character is *stable* if the canonical
mapping leaves it alone and it can't compose with what stands before it; a segment is one stable starter (the boundary context)
followed by unstable characters. Only segments are rewritten, and spliced back between the untouched stretches. Values that are a
known form as they stand are taken out by a join before anything is rewritten.

The canonical form ("look") drops invisible and blank characters, folds width variants, ligatures, radicals and compatibility
ideographs, composes combining marks, and sends look-alike letters of other scripts to one prototype. Case, voicing marks, small
or missing kana, raised and lowered digits or letters stay as they are.

Edge cases: null gives null; "" and a string of only blanks give ""; very long strings are handled segment by segment; repeated
rows give repeated results (``lookalikes`` returns each (field, id, form) once); an empty table gives an empty result; columns
beside the named ones are neither read nor touched.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that look like a letter of another script, by prototype (Latin), then kana by kanji, strokes and kana.
LOOKS = {
    "A": "ΑАᎪ", "B": "ΒВ", "C": "СϹ", "D": "Ꭰ", "E": "ΕЕ", "G": "Ԍ", "H": "ΗН", "I": "ΙІӀ", "J": "ЈͿ", "K": "ΚКK", "L": "Ꮮ", "M": "ΜМ",
    "N": "Ν", "O": "ΟОՕ", "P": "ΡР", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏ", "T": "ΤТ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ΧХ", "Y": "ΥҮ", "Z": "ΖᏃ",
    "a": "аɑα", "b": "Ьᖯ", "c": "сϲ", "d": "ԁ", "e": "е", "f": "ſƒ", "g": "ɡ", "h": "һ", "i": "іι", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ո", "o": "οоօ", "p": "рρ",
    "q": "ԛ", "r": "г", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уүγ", "z": "ᴢ",
    "Ä": "Ӓ", "Ö": "Ӧ", "ä": "ӓ", "ë": "ё", "ï": "ї", "ö": "ӧ", "ß": "β",
    "カ": "力", "ロ": "口囗", "ニ": "二", "エ": "工", "タ": "夕", "ト": "卜", "ハ": "八", "オ": "才", "チ": "千", "ミ": "彡", "ヌ": "又", "メ": "乄", "ヨ": "彐", "ム": "厶", "サ": "廾", "セ": "乜",
    "ー": "一―—–─━‐‑‒−⼀㇐", "ノ": "丿", "ヘ": "へ", "ベ": "べ", "ペ": "ぺ", "リ": "り",
}
#: Compatibility mappings that change what a reader sees; they stay as they are.
KEPT_TAGS = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<vertical>")


def _invisible(c: str) -> bool:
    o = ord(c)
    return unicodedata.category(c) in ("Cf", "Cc", "Zs", "Zl", "Zp") or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x2800, 0x180B, 0x180C, 0x180D, 0x180F)


_PROTO = {x: p for p, xs in LOOKS.items() for x in xs}


@lru_cache(maxsize=None)
def _map(c: str) -> str:
    """What one character becomes before composition."""
    if c in _PROTO:
        return _PROTO[c]
    if c in "゛ﾞ":
        return "゙"
    if c in "゜ﾟ":
        return "゚"
    if _invisible(c):
        return ""
    d = unicodedata.decomposition(c)
    if d.startswith("<"):
        if d.startswith(KEPT_TAGS):
            return c
        d = d.partition("> ")[2]
        return "".join(_map(chr(int(x, 16))) for x in d.split())
    n = unicodedata.normalize("NFC", c)
    return _PROTO.get(n, n)


def look(s: str) -> str:
    """The canonical form of a whole string, the slow definition: map every character, compose, map what composing made."""
    s = unicodedata.normalize("NFC", "".join(map(_map, s)))
    return "".join(map(_map, s)) if any(c in _PROTO for c in s) else s


def _unstable(c: str) -> bool:
    return _map(c) != c or unicodedata.combining(c) != 0 or c in "゙゚" or 0x1160 <= ord(c) <= 0x11FF


@lru_cache(maxsize=1)
def _second() -> frozenset[str]:
    """Characters that stand behind another in a canonical decomposition, vowel signs of class 0 among them."""
    pairs = (unicodedata.decomposition(chr(o)).split() for o in range(0x30000))
    return frozenset(chr(int(d[1], 16)) for d in pairs if len(d) == 2 and not d[0].startswith("<"))


def _is_late(c: str) -> bool:
    """Quick check 'maybe': may compose with a character before it."""
    return unicodedata.combining(c) != 0 or 0x1160 <= ord(c) <= 0x11FF or c in _second()


@lru_cache(maxsize=1)
def unstable_ranges() -> tuple[tuple[int, int], ...]:
    """Code point ranges of unstable characters, from the Unicode data of the running Python."""
    out: list[list[int]] = []
    for o in [*range(0x30000), *range(0xE0000, 0xE0200)]:
        if 0xD800 <= o < 0xE000 or 0xE000 <= o < 0xF900 or 0xAC00 <= o < 0xD7A4:
            continue
        c = chr(o)
        if unicodedata.category(c) != "Cn" and (_unstable(c) or _is_late(c)):
            if out and out[-1][1] == o - 1:
                out[-1][1] = o
            else:
                out.append([o, o])
    return tuple((a, b) for a, b in out)


def segment_pattern(ranges: tuple[tuple[int, int], ...]) -> re.Pattern:
    cls = "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    return re.compile(f"[^{cls}]?[{cls}]+")


def look_spliced(s: str, pattern: re.Pattern) -> str:
    """``look`` by segments: stable stretches are copied, each unstable run is rewritten together with the starter before it."""
    return pattern.sub(lambda m: look(m[0]), s)


def canonical(column: Column) -> Column:
    """The canonical form of a string column, worked out once per distinct value of a batch. Not deterministic in name only: so the
    planner neither repeats it nor moves it below the filters and joins that thin out its input."""
    ranges = unstable_ranges()

    @F.pandas_udf("string")
    def rewrite(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pattern = segment_pattern(ranges)
        for s in parts:
            forms = {v: look_spliced(v, pattern) for v in s.dropna().unique()}
            yield s.map(forms).astype(object).where(s.notna(), None)

    return rewrite.asNondeterministic()(column)


def lookalikes(values: DataFrame, lexicon: DataFrame, max_lexicon: int = 100_000) -> DataFrame:
    """values(field, row_id, value, kind) against lexicon(kind, lex_form): rows (field, row_id, lex_form) where value differs from
    every form of its kind but has the look of lex_form. The lexicon side is broadcast only after its size is checked."""
    from ..session import broadcast_if_small

    forms = lexicon.where(F.col("lex_form").isNotNull()).distinct()
    plain = broadcast_if_small(forms.withColumnRenamed("lex_form", "value"), max_lexicon)
    rest = values.where(F.col("value").isNotNull()).join(plain, ["kind", "value"], "left_anti")
    keyed = broadcast_if_small(forms.withColumn("look", canonical(F.col("lex_form"))), max_lexicon)
    # A value without an unstable character is its own look, and is no form: only looks of forms that differ from the form can match it.
    return rest.withColumn("look", canonical(F.col("value"))).join(keyed, ["kind", "look"]).where(F.col("look") != "").select("field", "row_id", "lex_form").distinct()
