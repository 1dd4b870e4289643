"""Leaf blocks of HTML, Markdown, wiki and LaTeX sources: the common document tree that ``blocks`` labels.

Every reader gives ``Leaf(path, raw, text)``: the tags above the leaf, its source without outer delimiters, and its visible text
with inline markup reduced to words. What kind of block a leaf is, or that it is residue, is decided by the labeller, not here.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from typing import NamedTuple


class Leaf(NamedTuple):
    path: str  # tags from the root, e.g. "html/ol/li" or "md/quote/p"
    raw: str
    text: str


# Private-use characters stand for pieces that inline rules must not touch: open, close, and the digits 0 to 9 between them.
OPEN, CLOSE, DIGIT = "", "", 0xE010
_HELD = re.compile("([-]+)")


class Held:
    def __init__(self) -> None:
        self.pieces: list[str] = []

    def keep(self, s: str) -> str:
        self.pieces.append(s)
        return OPEN + "".join(chr(DIGIT + int(d)) for d in str(len(self.pieces) - 1)) + CLOSE

    def back(self, s: str) -> str:
        while _HELD.search(s):
            s = _HELD.sub(lambda m: self.pieces[int("".join(str(ord(c) - DIGIT) for c in m[1]))], s)
        return s


def clear(s: str) -> str:
    """Without the private-use characters that the readers use themselves."""
    return re.sub("[-]", "", s)


# ---------------------------------------------------------------- which system

_BLOCK_TAGS = "p|h[1-6]|ul|ol|li|div|script|style|pre|nav|blockquote|section|article|table|header|footer|aside|main|embed-katex"
_HTML = re.compile(rf"<(?:{_BLOCK_TAGS})(?:\s[^>]*)?>", re.I)
_ESCAPED = re.compile(rf"&lt;/?(?:{_BLOCK_TAGS})(?:\s.*?)?&gt;", re.I | re.S)
_TEX = re.compile(r"\\(?:begin\{(?!cases|matrix|pmatrix|aligned)|documentclass|(?:sub)*section\*?\{|item\b|textbf\{|emph\{|texttt\{|href\{)|\{\\bf ")
_WIKI = re.compile(r"^={2,6}[^=\n].*=\s*$|\[\[[^\]\n]+\]\]|\{\{[^}]+\}\}|<(?:syntaxhighlight|ref|math|nowiki)\b|'''|^\{\||\[https?://\S+ [^\]\n]+\]", re.M)
_MD = re.compile(r"^#{1,6} |\*\*|\]\([^)\s]+|^ {0,3}(?:```|~~~)|^(?:-{3,}|={3,})\s*$|^ {0,3}[-*+] |^ {0,3}\d+[.)] |^> |`[^`\n]+`|^\$\$|\[\^|<!--", re.M)


def system(body: str) -> str:
    """Which markup the body really is, whatever is declared."""
    bare = re.sub(r"(?ms)^ {0,3}(`{3,}|~{3,}).*?^ {0,3}\1[`~]*\s*$|`[^`\n]+`", "", body)
    score = {
        "html": 3 * len(_HTML.findall(bare)),
        "escaped": 3 * len(_ESCAPED.findall(bare)),
        "tex": 2 * len(_TEX.findall(bare)),
        "wiki": 2 * len(_WIKI.findall(bare)),
        "md": len(_MD.findall(body)),
    }
    if score["wiki"] and re.search(r"<(?:pre|syntaxhighlight)\b", bare) and not re.search(r"<(?:p|li|h[1-6])\b", bare, re.I):
        score["html"] = 0
    best = max(score, key=lambda k: score[k])
    return best if score[best] else "md"


# ---------------------------------------------------------------- HTML

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_FLOW = set("p h1 h2 h3 h4 h5 h6 ul ol li div pre nav blockquote section article table tr td th thead tbody header footer aside main form figure figcaption dl dt dd hr address body html head title embed-katex".split())
_VOID = set("br img hr meta link input source wbr col area base".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_LISTS = {"ul", "ol", "dl", "table"}


def _attr(s: str, name: str) -> str:
    m = re.search(rf"\b{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", s, re.I)
    return m[1].strip("\"'").lower() if m else ""


def read_html(body: str) -> list[Leaf]:
    out: list[Leaf] = []
    stack: list[str] = []
    buf: list[str] = []
    skip = ""  # a dropped inline element
    depth = 0

    def flush() -> None:
        s = "".join(buf)
        buf.clear()
        if s.strip():
            t = html.unescape(s)
            out.append(Leaf("/".join(["html", *stack]), t, t))

    def close(to: int) -> None:
        flush()
        del stack[to:]

    at = 0
    for m in [*_TAG.finditer(body), None]:
        if m and m.start() < at:
            continue
        chunk = body[at : m.start() if m else len(body)]
        if not skip:
            buf.append(chunk)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if not skip and m[0].startswith("<!--") and not "".join(buf).strip():
                out.append(Leaf("/".join(["html", *stack, "comment"]), m[0], m[0]))
            continue
        end, attrs = m[1] == "/", m[3] or ""
        if skip:
            if tag == skip:
                depth += -1 if end else 1
                skip = skip if depth else ""
            continue
        if tag in ("script", "style", "textarea", "template", "noscript") and not end:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(body, at)
            raw = body[at : stop.start() if stop else len(body)]
            at = stop.end() if stop else len(body)
            flush()
            kind = tag + ("[math]" if "math/tex" in _attr(attrs, "type") and "display" in _attr(attrs, "type") else "[inline]" if "math/tex" in _attr(attrs, "type") else "")
            if kind.endswith("[inline]"):
                buf.append(raw)
            elif raw.strip():
                out.append(Leaf("/".join(["html", *stack, kind]), html.unescape(raw) if kind.endswith("]") else raw, raw))
            continue
        if tag == "math" and not end:
            continue
        if tag == "sup" and not end and ("footnote" in _attr(attrs, "class") or "reference" in _attr(attrs, "class")):
            skip, depth = "sup", 1
            continue
        if tag == "span" and not end and "math" in _attr(attrs, "class"):
            stop = re.compile(r"</span\s*>", re.I).search(body, at)
            raw = body[at : stop.start() if stop else len(body)]
            at = stop.end() if stop else len(body)
            buf.append(re.sub(r"^\s*(?:\\\(|\$)|(?:\\\)|\$)\s*$", "", raw))
            continue
        if tag in ("br", "wbr"):
            buf.append("\n")
        if tag in _VOID or tag not in _FLOW:
            if tag == "hr":
                flush()
            continue
        if not end:
            if tag in _CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    name = stack[k].partition("[")[0]
                    if name in _CLOSES[tag]:
                        close(k)
                        break
                    if name in _LISTS:
                        break
            elif stack and stack[-1].partition("[")[0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and tag not in ("embed-katex",):
                close(len(stack) - 1)
            flush()
            if tag == "pre":
                stop = re.compile(r"</pre\s*>", re.I).search(body, at)
                raw = body[at : stop.start() if stop else len(body)]
                at = stop.end() if stop else len(body)
                t = html.unescape(_TAG.sub("", raw))
                if t.strip():
                    out.append(Leaf("/".join(["html", *stack, "pre"]), t, t))
                continue
            cls = _attr(attrs, "class")
            name = tag + ("[math]" if "math" in cls and "display" in cls or tag == "embed-katex" and "display-mode" in attrs else "[nav]" if _attr(attrs, "role") == "navigation" or "nav" in cls.split() else "")
            stack.append(name)
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].partition("[")[0] == tag:
                    close(k)
                    break
            else:
                if tag in ("p", "li"):
                    flush()
    close(0)
    return out


# ---------------------------------------------------------------- Markdown

_FRONT = re.compile(r"^(?:[\w.-]+:(?:\s.*)?|\s*-(?:\s.*)?|\s+.*|\s*)$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*([^`\n]*)$")
_ITEM = re.compile(r"^(\s*)(?:[-*+]|\d{1,9}[.)])(?:\s+|$)(.*)$")
_ATX = re.compile(r"^ {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_INLINE_TAG = re.compile(r"</?(?:b|i|em|strong|u|s|del|ins|sub|sup|kbd|mark|small|span|a|br|code|q|abbr|cite|font|big|tt)(?:\s[^<>]*)?/?>", re.I)


def md_inline(s: str) -> str:
    held = Held()
    s = re.sub(r"(?<!\\)(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: held.keep(m[2]), s, flags=re.S)
    s = re.sub(r"<!--.*?-->", "", s, flags=re.S)
    s = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: held.keep(m[1]), s)
    s = re.sub(r"\$\$(.+?)\$\$|(?<![\w$])\$(?=\S)([^$\n]+?)(?<=\S)\$(?![\d$])", lambda m: held.keep(m[1] or m[2]), s, flags=re.S)
    s = re.sub(r"!\[[^\]]*\](?:\([^)]*\)|\[[^\]]*\])", "", s)
    s = re.sub(r"\[\^[^\]\s]+\]", "", s)
    link = re.compile(r"\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(\s*<?[^()\s>]*(?:\([^()\s]*\)[^()\s]*)*>?(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)")
    s = link.sub(lambda m: m[1], s)
    s = re.sub(r"\[([^\[\]]+)\]\[[^\[\]]*\]", r"\1", s)
    s = re.sub(r"(\*\*\*|\*\*)(?=\S)(.+?)(?<=\S)\1", r"\2", s, flags=re.S)
    s = re.sub(r"(?<![*\w])\*(?=[^\s*])(.+?)(?<=[^\s*])\*(?!\*)|\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*", lambda m: m[1] or m[2], s, flags=re.S)
    s = re.sub(r"(?<!\w)(__|_)(?=\S)([^_]+?)(?<=\S)\1(?!\w)", r"\2", s)
    s = re.sub(r"~~(?=\S)(.+?)(?<=\S)~~", r"\1", s)
    s = _INLINE_TAG.sub("", s)
    return held.back(html.unescape(s))


def _drop_comments(body: str) -> str:
    """HTML comments outside fenced code."""
    out, fence, text = [], "", []
    for line in body.split("\n"):
        m = _FENCE.match(line)
        if fence:
            text.append(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                out.append("\n".join(text))
                text, fence = [], ""
        elif m:
            out.append(re.sub(r"<!--.*?-->", "", "\n".join(text), flags=re.S) if text else None)
            text, fence = [line], m[1]
        else:
            text.append(line)
    out.append(("\n".join(text) if fence else re.sub(r"<!--.*?-->", "", "\n".join(text), flags=re.S)) if text else None)
    return "\n".join(x for x in out if x is not None)


def read_md(body: str, base: str = "md", inline: Callable[[str], str] = md_inline) -> list[Leaf]:
    lines = _drop_comments(body).split("\n") if base == "md" else body.split("\n")
    out: list[Leaf] = []
    buf: list[str] = []
    tag = "p"

    def flush() -> None:
        nonlocal tag
        s = "\n".join(buf)
        buf.clear()
        if s.strip():
            out.append(Leaf(f"{base}/{tag}", s, inline(s)))
        tag = "p"

    k, n, blank = 0, len(lines), True
    if base == "md" and n > 2 and lines[0].strip() == "---" and re.match(r"^\w+:", lines[1]):
        close = next((j for j in range(1, n) if lines[j].strip() == "---"), 0)
        # what is longer must look like front matter throughout, as a rule further down may close nothing
        if close and (close < 30 or all(_FRONT.match(x) for x in lines[1:close])):
            k = close + 1
            out.append(Leaf("md/front", "\n".join(lines[1:close]), "\n".join(lines[1:close])))
    while k < n:
        line = lines[k]
        bare = line.strip()
        if not bare:
            flush()
            blank = True
            k += 1
            continue
        m = _FENCE.match(line)
        if m:
            flush()
            j = k + 1
            while j < n and not ((c := re.match(r"^ {0,3}(`{3,}|~{3,})[ \t]*$", lines[j])) and c[1][0] == m[1][0] and len(c[1]) >= len(m[1])):
                j += 1
            raw = "\n".join(lines[k + 1 : j])
            out.append(Leaf(f"{base}/fence" + ("[math]" if m[2].strip().lower() in ("math", "latex-display", "katex") else ""), raw, raw))
            k, blank = j + 1, False
            continue
        opener = next((x for x in (("$$", "$$"), ("\\[", "\\]")) if bare.startswith(x[0])), None)
        if opener and not buf:
            j, rest = k, bare[2:]
            while opener[1] not in rest and j + 1 < n:
                j += 1
                rest += "\n" + lines[j]
            if opener[1] in rest and not rest.partition(opener[1])[2].strip():
                raw = rest.partition(opener[1])[0]
                out.append(Leaf(f"{base}/display", raw, raw))
                k, blank = j + 1, False
                continue
        if re.match(r"^(?: {4}|\t)", line) and blank and not buf and not (out and out[-1].path.endswith("/li") and _ITEM.match(line)):
            j = k
            while j < n and (not lines[j].strip() or re.match(r"^(?: {4}|\t)", lines[j])):
                j += 1
            raw = "\n".join(lines[k:j]).rstrip()
            out.append(Leaf(f"{base}/indented", raw, raw))
            k, blank = j, True
            continue
        if m := _ATX.match(line):
            flush()
            out.append(Leaf(f"{base}/h", m[1] or "", inline(m[1] or "")))
        elif buf and tag == "p" and re.match(r"^ {0,3}(?:=+|-{2,})\s*$", line):
            tag = "h"
            flush()
        elif not buf and re.match(r"^ {0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$", line):
            pass
        elif re.match(r"^ {0,3}>", line):
            flush()
            j, quoted = k, []
            while j < n and re.match(r"^ {0,3}>", lines[j]):
                quoted.append(re.sub(r"^ {0,3}> ?", "", lines[j]))
                j += 1
            out.extend(read_md("\n".join(quoted), f"{base}/quote", inline))
            k, blank = j, False
            continue
        elif (m := _ITEM.match(line)) and (m[2].strip() or not buf):
            flush()
            tag = "li"
            buf.append(m[2])
        elif re.match(r"^ {0,3}\[[^\]]+\]:\s", line) and not buf:
            out.append(Leaf(f"{base}/definition", line, line))
        elif re.match(r"^\s*\|.*\|\s*$", line):
            flush()
            out.append(Leaf(f"{base}/table", line, line))
        else:
            buf.append(line)
        k += 1
        blank = False
    flush()
    return out


# ---------------------------------------------------------------- wiki

def _no_templates(s: str) -> str:
    prev = None
    while prev != s:
        prev, s = s, re.sub(r"\{\{[^{}]*\}\}", "", s)
    return re.sub(r"(?ms)^\{\|.*?^\|\}", "", s)


def wiki_inline(s: str, held: Held) -> str:
    s = re.sub(r"<math(?:\s[^>]*)?>(.*?)</math>", lambda m: held.keep(html.unescape(m[1])), s, flags=re.S | re.I)
    prev = None
    while prev != s:
        prev = s
        s = re.sub(r"\[\[(?:File|Image|ファイル|画像|Category|カテゴリ|Datei|Archivo|Fichier)\s*:[^\[\]]*\]\]", "", s, flags=re.I)
        s = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", s)
    s = re.sub(r"\[(?:https?:)?//\S+\s+([^\]\n]*)\]", r"\1", s)
    s = re.sub(r"\[(?:https?:)?//\S+\]", "", s)
    s = re.sub(r"'{2,5}", "", s)
    s = re.sub(r"__[A-Z]+__", "", s)
    s = re.sub(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>", "", s)
    return held.back(html.unescape(s))


def read_wiki(body: str) -> list[Leaf]:
    held = Held()
    blocks: dict[str, tuple[str, str]] = {}

    def block(path: str, raw: str) -> str:
        key = held.keep("")
        blocks[key] = (path, raw)
        return f"\n{key}\n"

    s = re.sub(r"<nowiki>(.*?)</nowiki>", lambda m: held.keep(m[1]), body, flags=re.S | re.I)
    s = re.sub(r"<(syntaxhighlight|source)(?:\s[^>]*)?>(.*?)</\1>", lambda m: block("code", m[2]), s, flags=re.S | re.I)
    s = re.sub(r"<pre(?:\s[^>]*)?>(.*?)</pre>", lambda m: block("pre", html.unescape(m[1])), s, flags=re.S | re.I)
    s = re.sub(r"<!--.*?-->", "", s, flags=re.S)
    s = re.sub(r"<ref(?:\s[^>]*)?/>|<ref(?:\s[^>]*)?>.*?</ref>", "", s, flags=re.S | re.I)
    s = re.sub(r"<code(?:\s[^>]*)?>(.*?)</code>", lambda m: held.keep(html.unescape(m[1])), s, flags=re.S | re.I)
    s = re.sub(r"<math\s[^>]*display\s*=\s*[\"']?block[^>]*>(.*?)</math>", lambda m: block("math[block]", html.unescape(m[1])), s, flags=re.S | re.I)
    s = re.sub(r"(?m)^\{\{(?:[^{}]|\{\{[^{}]*\}\})*\}\}[ \t]*$", lambda m: block("template", m[0]), s)
    s = re.sub(r"(?ms)^\{\|.*?^\|\}", lambda m: block("table", m[0]), s)
    s = _no_templates(s)
    out: list[Leaf] = []
    buf: list[str] = []

    def flush() -> None:
        t = "\n".join(buf)
        buf.clear()
        if t.strip():
            out.append(Leaf("wiki/p", t, wiki_inline(t, held)))

    for line in s.split("\n"):
        bare = line.strip()
        if bare in blocks:
            flush()
            path, raw = blocks[bare]
            out.append(Leaf(f"wiki/{path}", raw, raw))
        elif not bare:
            flush()
        elif m := re.match(r"^(={1,6})\s*(.*?)\s*\1\s*$", bare):
            flush()
            out.append(Leaf("wiki/h", m[2], wiki_inline(m[2], held)))
        elif m := re.match(r"^:*\s*<math(?:\s[^>]*)?>((?:(?!</math>).)*)</math>\s*$", bare) if bare.startswith(":") else None:
            flush()
            out.append(Leaf("wiki/dd/math", html.unescape(m[1]), html.unescape(m[1])))
        elif m := re.match(r"^([*#:;]+)\s*(.*)$", bare):
            flush()
            out.append(Leaf("wiki/li" if m[1][-1] in "*#" else "wiki/dd", m[2], wiki_inline(m[2], held)))
        elif re.match(r"^-{4,}$", bare):
            flush()
        else:
            buf.append(line)
    flush()
    return out


# ---------------------------------------------------------------- LaTeX

_MATH_ENV = "equation|align|gather|multline|eqnarray|displaymath|alignat|flalign"


def _arg(s: str, k: int) -> int:
    """Position behind the group in braces that opens at k."""
    depth = 0
    while k < len(s):
        if s[k] == "\\":
            k += 2
            continue
        depth += (s[k] == "{") - (s[k] == "}")
        k += 1
        if depth == 0:
            return k
    return len(s)


def _replace_command(s: str, names: str, what: Callable[[list[str]], str], args: int = 1) -> str:
    rx = re.compile(rf"\\(?:{names})\*?(?![A-Za-z])\s*(?:\[[^\]]*\])?(?=\s*\{{)")
    out, at = [], 0
    while m := rx.search(s, at):
        k, got = m.end(), []
        for _ in range(args):
            while k < len(s) and s[k].isspace():
                k += 1
            if k >= len(s) or s[k] != "{":
                break
            e = _arg(s, k)
            got.append(s[k + 1 : e - 1])
            k = e
        out += [s[at : m.start()], what(got)]
        at = k
    return "".join(out) + s[at:]


def tex_inline(s: str, held: Held) -> str:
    s = re.sub(r"\\([_&%#${}])", lambda m: held.keep(m[1]), s)
    s = re.sub(r"\\\((.+?)\\\)|\$([^$]+)\$", lambda m: held.keep(m[1] if m[1] is not None else m[2]), s, flags=re.S)
    s = _replace_command(s, "label|cite|citep|citet|ref|eqref|pageref|footnote|footnotemark|includegraphics|index|bibliography|bibliographystyle|input|vspace|hspace|url|thanks", lambda a: "")
    s = _replace_command(s, "href", lambda a: a[-1] if len(a) > 1 else "", 2)
    s = re.sub(r"\\\\(?:\[[^\]]*\])?", "\n", s)
    s = re.sub(r"\\(?:verb)\*?(\W)(.*?)\1", lambda m: held.keep(m[2]), s)
    s = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?[ \t]?", "", s)
    s = re.sub(r"\\[,;:!/ ]", " ", s)
    s = re.sub(r"[{}]", "", s).replace("~", " ")
    return held.back(s)


def read_tex(body: str) -> list[Leaf]:
    held = Held()
    blocks: dict[str, tuple[str, str]] = {}
    out: list[Leaf] = []

    def block(path: str, raw: str) -> str:
        key = held.keep("")
        blocks[key] = (path, raw)
        return f"\n\n{key}\n\n"

    m = re.search(r"\\begin\{document\}", body)
    if m:
        out.append(Leaf("tex/preamble", body[: m.start()], body[: m.start()]))
        body = body[m.end() :]
    body = body.partition("\\end{document}")[0]
    s = re.sub(r"\\begin\{(verbatim|lstlisting|minted|Verbatim)\*?\}(?:\[[^\]]*\])?(?:(?<=minted\})\{\w+\})?(.*?)\\end\{\1\*?\}", lambda m: block("code", m[2]), body, flags=re.S)
    s = re.sub(r"(?<!\\)%[^\n]*\n?[ \t]*", "", s)
    s = re.sub(rf"\\begin\{{((?:{_MATH_ENV})\*?)\}}(.*?)\\end\{{\1\}}", lambda m: block("math", re.sub(r"\\label\{[^}]*\}", "", m[2])), s, flags=re.S)
    s = re.sub(r"(?<!\\)\\\[(.*?)\\\]|\$\$(.*?)\$\$", lambda m: block("math", m[1] if m[1] is not None else m[2]), s, flags=re.S)
    s = re.sub(r"\\(?:documentclass|usepackage|newcommand|renewcommand|title|author|date|bibliographystyle|bibliography|pagestyle)\*?(?:\[[^\]]*\])?(?:\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\})+", "", s)
    s = re.sub(r"\\(?:maketitle|tableofcontents|newpage|clearpage|noindent|centering|par)(?![A-Za-z])", "\n\n", s)
    s = re.sub(r"\\begin\{(?:figure|table|tabular|thebibliography|tikzpicture)\*?\}.*?\\end\{(?:figure|table|tabular|thebibliography|tikzpicture)\*?\}", lambda m: block("float", m[0]), s, flags=re.S)
    s = _replace_command(s, "(?:part|chapter|(?:sub)*section|paragraph|subparagraph)", lambda a: block("h", a[0] if a else ""))
    env: list[str] = []
    item = False
    buf: list[str] = []

    def flush() -> None:
        t = "".join(buf)
        buf.clear()
        if t.strip():
            out.append(Leaf("/".join(["tex", *env, "item" if item else "p"]), t, tex_inline(t, held)))

    for piece in re.split(r"(\\begin\{\w+\*?\}(?:\[[^\]]*\])?|\\end\{\w+\*?\}|\\item(?![A-Za-z])(?:\s*\[[^\]]*\])?|\n[ \t]*\n\s*)", s):
        if piece.startswith("\\begin{"):
            flush()
            env.append(re.match(r"\\begin\{(\w+)", piece)[1])
            item = False
        elif piece.startswith("\\end{"):
            flush()
            if env:
                env.pop()
            item = False
        elif piece.startswith("\\item"):
            flush()
            item = True
        elif re.fullmatch(r"\n[ \t]*\n\s*", piece):
            flush()
            item = item and bool(env)
        elif piece.strip() in blocks:
            flush()
            path, raw = blocks[piece.strip()]
            out.append(Leaf(f"tex/{path}", raw, tex_inline(raw, held) if path == "h" else raw))
        else:
            buf.append(piece)
    flush()
    return out


def leaves(body: str | None) -> list[Leaf]:
    """Leaf blocks of a body in whatever system it is written."""
    if not body or not body.strip():
        return []
    body = clear(body.replace("\r\n", "\n").replace("\r", "\n"))
    kind = system(body)
    if kind == "escaped":
        return read_html(html.unescape(body))
    return {"html": read_html, "md": read_md, "wiki": read_wiki, "tex": read_tex}[kind](body)
