"""The functions of the core as SQL expressions, for comparison. Nothing here is taken from the expressions they are compared with:
lines are cut and folded where those use one pattern, kana are moved by their code points, and what must be equal is written out."""

from __future__ import annotations

from ..types import LOOSE, NormalizeOptions

# White space, scripts, addresses, residue, brackets and entities; voiced, small and drawn-out kana.
BLANK = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SIDE = r"\t\x{0b}-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
JAPANESE, KANJI = "ぁ-ゟ゠-ヿ一-鿿々\u3040", "一-鿿々"
ADDRESS = r"https?://[A-Za-z0-9._~:/?#\[\]@!$&'()+,;=%-]*"
LEFTOVER = ("http", "..", "[", "|", "`", "<", ">", "{", "}", "\\", "=", "#", "$", ";", "_", "~", "]")
PAIRS = ("()", "（）", "「」", "『』")
NAMED = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
MARKED = "ガギグゲゴザジズゼゾダヂヅデドバパビピブプベペボポヴ"
UNMARKED = "カキクケコサシスセソタチツテトハハヒヒフフヘヘホホウ"
LITTLE, LARGE = "ァィゥェォャュョヮヵヶ", "アイウエオヤユヨワカケ"
ROWS = {"A": "アカサタナハマヤラワガザダバパァャヮヵ", "I": "イキシチニヒミリヰギジヂビピィ", "U": "ウクスツヌフムユルグズヅブプヴゥュ", "E": "エケセテネヘメレヱゲゼデベペェヶ", "O": "オコソトノホモヨロヲゴゾドボポォョ"}
LONE = "アイウエオ"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(c: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({c}, {lit(pattern)}, {lit(by)}, 'g')"


def trim(c: str) -> str:
    return sub(sub(c, f"^[{BLANK}]+"), f"[{BLANK}]+$")


def without_space(c: str) -> str:
    return sub(c, f"[{BLANK}]")


def lines(c: str) -> str:
    """Lines of a text; a last empty one is dropped."""
    parts = f"str_split_regex({c}, {lit(chr(13) + '?' + chr(10))})"
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"


def pieces(c: str) -> str:
    """Lines with the line feeds that end them."""
    parts = f"string_split({c}, chr(10))"
    return f"list_transform({parts}, lambda x, i: CASE WHEN i < len({parts}) THEN x || chr(10) ELSE x END)"


def fences(c: str) -> str:
    """A fold over the lines: within a fence or not, and what was kept so far."""
    edge = f"regexp_matches(x, {lit(f'^[{SIDE}]*(```|~~~)')})"
    step = f"CASE WHEN {edge} THEN (CASE WHEN a[1] = 'o' THEN 'i' ELSE 'o' END) || a[2:] WHEN a[1] = 'o' THEN a || x ELSE a END"
    return f"list_reduce({pieces(c)}, lambda a, x: {step}, 'o')[2:]"


def tables(c: str) -> str:
    return f"array_to_string(list_filter({pieces(c)}, lambda x: NOT starts_with({sub('x', f'^[{SIDE}]+')}, '|')), '')"


def markers(c: str) -> str:
    x = sub(sub(sub("x", f"^[{SIDE}]*#*[{SIDE}]*"), f"^(>[{SIDE}]*)+"), r"^([-*+]|[0-9]+\.) ")
    return f"array_to_string(list_transform({pieces(c)}, lambda x: {x}), '')"


def links(c: str) -> str:
    return sub(c, r"!\[[^\]\n]*\]\([^)\n]*\)|\[([^\]\n]*)\]\([^)\n]*\)", chr(92) + "1")


def addresses(c: str) -> str:
    return sub(c, ADDRESS)


def markdown(c: str) -> str:
    return f"translate({addresses(links(markers(tables(fences(c)))))}, '`*', '')"


def entities(c: str) -> str:
    for a, b in NAMED.items():
        c = f"replace({c}, {lit(a)}, {lit(b)})"
    return c


def tags(c: str) -> str:
    o, e = chr(1), chr(2)
    skipped = "|".join(rf"<{n}(?:[^a-z0-9>][^>]*)?>(?:.*?</{n}[^>]*>|.*\z)" for n in ("script", "style", "pre"))
    p = rf"(?is){skipped}|<(/+(?:p|div|li|h[1-6]|tr|table)|/*br)(?:[^a-z0-9>][^>]*)?>|<[^>]*>"
    return f"translate({sub(sub(c, p, o + chr(92) + '1' + e), f'{o}[^{e}]+{e}', chr(10))}, {lit(o + e)}, '')"


def plain(kind: str, c: str) -> str:
    return f"CASE WHEN {kind} = 'Markdown' THEN {markdown(c)} WHEN {kind} = 'Html' THEN {entities(tags(c))} ELSE {c} END"


def sentences(c: str) -> str:
    return f"list_filter(list_transform(str_split_regex({c}, {lit('[。！？' + chr(10) + ']')}), lambda x: {trim('x')}), lambda x: x <> '')"


def ratio(c: str, chars: str) -> str:
    n = f"length({without_space(c)})"
    return f"CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE length({sub(c, f'[^{chars}]')})::DOUBLE / {n} END"


def balanced(c: str) -> str:
    out = []
    for o, e in PAIRS:
        chars = f"string_split({c}, '')"
        out.append(f"list_reduce({chars}, lambda a, x: CASE WHEN a = '-' THEN a WHEN x = '{o}' THEN a || '.' WHEN x = '{e}' THEN CASE WHEN a = '' THEN '-' ELSE a[2:] END ELSE a END, '') = ''")
    return "(" + " AND ".join(out) + ")"


def residue(c: str) -> str:
    return "(" + " OR ".join(f"contains({c}, {lit(x)})" for x in LEFTOVER) + f" OR NOT {balanced(c)})"


def katakana(c: str) -> str:
    return f"array_to_string(list_transform(string_split({c}, ''), lambda x: CASE WHEN x BETWEEN 'ぁ' AND 'ゖ' THEN chr(unicode(x) + 96) ELSE x END), '')"


def vowel(c: str, none: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} <> '' AND contains('{kana}', {c}) THEN '{v}'" for v, kana in ROWS.items()) + f" ELSE {none} END"


def normalize(c: str, o: NormalizeOptions = LOOSE) -> str:
    s = katakana(c)
    if o.dakuten:
        s = f"translate({s}, '{MARKED}', '{UNMARKED}')"
    if o.small:
        s = f"translate({s}, '{LITTLE}', '{LARGE}')"
    if o.sokuon:
        s = f"replace({s}, 'ッ', '')"
    if not o.prolonged:
        return s
    v = vowel("x", "'-'")
    pair = f"(a[1] = ({v}) OR (a[1] = 'E' AND x = 'イ') OR (a[1] = 'O' AND x = 'ウ'))"
    step = f"CASE WHEN x = '' THEN a WHEN x = 'ー' THEN CASE WHEN a[1] = '-' THEN a ELSE a || 'ー' END WHEN contains('{LONE}', x) AND a[1] <> '-' AND {pair} THEN a || 'ー' ELSE ({v}) || substr(a, 2) || x END"
    return f"substr(list_reduce(string_split({s}, ''), lambda a, x: {step}, '-'), 2)"


def content_key(*parts: str) -> str:
    def le8(p: str) -> str:
        n = f"strlen({p})"
        return f"unhex(printf('%02x%02x%02x%02x00000000', {n} & 255, ({n} >> 8) & 255, ({n} >> 16) & 255, ({n} >> 24) & 255))"

    return "sha256(" + " || ".join(x for p in parts for x in (le8(p), f"encode({p})")) + ")"


def sentence_hash(c: str) -> str:
    return content_key(without_space(c))


def rate_key(c: str) -> str:
    return f"printf('%.3f', ({c})::FLOAT::DOUBLE)"


def audio_key(text: str, engine: str, voice: str, rate: str) -> str:
    return content_key(text, engine, voice, rate_key(rate))
