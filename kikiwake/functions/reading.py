"""Normalization of kana readings, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import LOOSE, NormalizeOptions

HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
# Voiced and half-voiced kana with their plain ones, small kana with their full ones, kana by vowel.
VOICED, PLAIN = "ガギグゲゴザジズゼゾダヂヅデドバパビピブプベペボポヴ", "カキクケコサシスセソタチツテトハハヒヒフフヘヘホホウ"
SMALL, FULL = "ァィゥェォャュョヮヵヶ", "アイウエオヤユヨワカケ"
VOWELS = {
    "A": "アカサタナハマヤラワガザダバパァャヮヵ",
    "I": "イキシチニヒミリヰギジヂビピィ",
    "U": "ウクスツヌフムユルグズヅブプヴゥュ",
    "E": "エケセテネヘメレヱゲゼデベペェヶ",
    "O": "オコソトノホモヨロヲゴゾドボポォョ",
}
ALONE = "アイウエオ"
# The vowels that draw out each vowel; E and O come before I and U, whose kana they take.
LENGTHENS = {"A": "ア", "E": "エイ", "I": "イ", "O": "オウ", "U": "ウ"}


def to_katakana(c: Column) -> Column:
    return F.translate(c, HIRAGANA, KATAKANA)


def strip_dakuten(c: Column) -> Column:
    return F.translate(c, VOICED, PLAIN)


def enlarge_small(c: Column) -> Column:
    return F.translate(c, SMALL, FULL)


def vowel_of(c: Column) -> Column:
    """A, I, U, E or O of one kana, else null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for v, kana in VOWELS.items():
        out = out.when(F.lit(kana).contains(c) & (c != ""), v)
    return out


def is_long_pair(before: Column, now: Column) -> Column:
    return (before == now) | ((before == "E") & (now == "I")) | ((before == "O") & (now == "U"))


def normalize(c: Column, opts: NormalizeOptions = LOOSE) -> Column:
    s = to_katakana(c)
    if opts.dakuten:
        s = strip_dakuten(s)
    if opts.small:
        s = enlarge_small(s)
    if opts.sokuon:
        s = F.replace(s, F.lit("ッ"), F.lit(""))
    if not opts.prolonged:
        return s
    # a mark of length without a vowel before it goes; then each vowel that only draws out the one before it becomes such a mark,
    # and goes on drawing it out (\\G), so that the vowel is that of the kana the run began with
    s = F.regexp_replace(s, f"(?<![{''.join(VOWELS.values())}ー])ー+", "")
    for v, run in LENGTHENS.items():
        s = F.regexp_replace(s, f"(?:(?<=[{VOWELS[v]}])|(?!^)\\G)(ー*)[{run}]", "$1ー")
    return s
