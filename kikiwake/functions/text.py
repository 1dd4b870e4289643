"""Text functions as column expressions: no Python runs per row, and each body is rewritten in place, without exploding lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as regular expressions of Java and of RE2 both read it; H is the same without the line feed.
WS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
H = r"\t\x{0b}-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
JAPANESE = r"\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{4e00}-\x{9fff}\x{3005}"
KANJI = r"\x{4e00}-\x{9fff}\x{3005}"

TRIM = f"^[{WS}]+|[{WS}]+$"
FENCE = rf"(?ms)^[{H}]*(?:```|~~~)[^\n]*(?:\n|\z)(?:.*?^[{H}]*(?:```|~~~)[^\n]*(?:\n|\z)|.*\z)"
TABLE_ROW = rf"(?m)^[{H}]*\|[^\n]*(?:\n|\z)"
MARKERS = rf"(?m)^[{H}]*#*[{H}]*(?:>[{H}]*)*(?:[-*+] |[0-9]+\. )?"
LINK = r"!\[[^\]\n]*\]\([^)\n]*\)|\[([^\]\n]*)\]\([^)\n]*\)"
URL = r"https?://[A-Za-z0-9\-._~:/?#\[\]@!$&'()+,;=%]*"
END_MARK = r"[。！？\n]"
RESIDUE = r"http|\.\.|[|`<>{}\\=#$;_~\[\]]"
BRACKETS = ("()", "（）", "「」", "『』")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
# Private-use characters stand for a line break and for a removed tag while tags are replaced in one pass.
_OPEN, _CLOSE = chr(0xE000), chr(0xE001)
TAG = r"(?is)<(?:(script|style|pre)(?![a-z0-9])[^>]*>(?:.*?</\1[^>]*>|.*\z)|(/+(?:p|div|li|h[1-6]|tr|table)(?![a-z0-9])|/*br(?![a-z0-9]))?[^>]*>)"


def replace_all(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, pattern, by)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, TRIM, "")


def is_blank(c: Column) -> Column:
    return F.coalesce(trim(c), F.lit("")) == ""


def lines(c: Column) -> Column:
    """Lines without their ends; no last empty line."""
    parts = F.split(c, r"\r?\n", -1)
    return F.when(c.isNull(), None).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, f"[{WS}]", "")


def strip_fences(c: Column) -> Column:
    return F.regexp_replace(c, FENCE, "")


def strip_tables(c: Column) -> Column:
    return F.regexp_replace(c, TABLE_ROW, "")


def strip_markers(c: Column) -> Column:
    return F.regexp_replace(c, MARKERS, "")


def strip_links(c: Column) -> Column:
    return F.regexp_replace(c, LINK, "$1")


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, "")


def strip_emphasis(c: Column) -> Column:
    return F.translate(c, "`*", "")


def strip_markdown(c: Column) -> Column:
    return strip_emphasis(strip_urls(strip_links(strip_markers(strip_tables(strip_fences(c))))))


def decode_entities(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_tags(c: Column) -> Column:
    c = F.regexp_replace(c, TAG, f"{_OPEN}$2{_CLOSE}")
    return F.translate(F.regexp_replace(c, f"{_OPEN}[^{_CLOSE}]+{_CLOSE}", "\n"), _OPEN + _CLOSE, "")


def strip_html(c: Column) -> Column:
    return decode_entities(strip_tags(c))


def plain_text(kind: Column, body: Column) -> Column:
    return F.when(kind == "Markdown", strip_markdown(body)).when(kind == "Html", strip_html(body)).otherwise(body)


def split_sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, END_MARK, -1), trim), lambda x: x != "")


def strip_punct(c: Column) -> Column:
    return F.translate(c, "、。，．", "")


def ratio(c: Column, chars: str) -> Column:
    """Share of these characters among those that are not white space; 0 where there are none."""
    n = F.char_length(without_space(c))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.char_length(F.regexp_replace(c, f"[^{chars}]", "")) / n)


def japanese_ratio(c: Column) -> Column:
    return ratio(c, JAPANESE)


def kanji_ratio(c: Column) -> Column:
    return ratio(c, KANJI)


def unbalanced(c: Column) -> Column:
    """Any bracket type that closes before it opens, or stays open. The state is the depth, -1 once it went below zero."""

    def one(o: str, e: str) -> Column:
        only = F.regexp_replace(c, rf"[^\{o}\{e}]" if o == "(" else f"[^{o}{e}]", "")
        depth = F.aggregate(F.split(only, ""), F.lit(0), lambda a, x: F.when(a < 0, a).when(x == o, a + 1).when(x == e, a - 1).otherwise(a))
        return (only != "") & (depth != 0)

    return reduce(lambda a, b: a | b, (one(o, e) for o, e in BRACKETS))


def has_residue(c: Column) -> Column:
    return c.rlike(RESIDUE) | unbalanced(c)
