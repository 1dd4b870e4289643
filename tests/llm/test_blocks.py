from __future__ import annotations

import numpy as np
import pytest

from kikiwake.llm import blocks as B
from kikiwake.llm.markup import leaves, system

HTML = "<nav><ul><li><a href='/'>top</a></li></ul></nav><script>var s='<p>x</p>';</script><h2 id=a>題&amp;名</h2><p>本<b>文</b><!-- no -->だ<br>続き <code>a_b</code><sup class=\"footnote-ref\"><a>1</a></sup> <span class=\"math\">\\(x_1\\)</span><ul><li>一<ul><li>二</ul><li>三</ul><pre><code>a &lt; b</code></pre><p>$$y^2$$</p>"
MD = "## 題&amp;名 ##\n\n本**文**<!-- no -->だ\n続き `a_b`[^1] $x_1$\n\n- 一\n  - 二\n- 三\n\n```py\na < b\n```\n\n$$\ny^2\n$$\n"
WIKI = "{{箱\n| a = 1\n}}\n== 題&amp;名 ==\n\n本'''文'''<!-- no -->だ\n続き <code>a_b</code><ref>no</ref> <math>x_1</math>\n\n* 一\n** 二\n*三\n\n<syntaxhighlight lang=\"py\">\na < b\n</syntaxhighlight>\n\n:<math>y^2</math>\n[[File:x.png|thumb]]"
TEX = "\\documentclass{article}\n\\begin{document}\n\\section*{題\\&名}\n\n本\\textbf{文}% no\nだ\n続き \\texttt{a\\_b}\\cite{k} $x_1$\\label{s}\n\n\\begin{itemize}\n\\item 一\n\\begin{itemize}\n\\item 二\n\\end{itemize}\n\\item 三\n\\end{itemize}\n\n\\begin{verbatim}\na < b\n\\end{verbatim}\n\n\\begin{equation}\ny^2\n\\end{equation}\n\\end{document}"
WANT = {("heading", "題&名"), ("para", "本文だ続きa_bx_1"), ("item", "一"), ("item", "二"), ("item", "三"), ("code", "a<b"), ("formula", "y^2")}


def field():
    pages = [leaves(x) for x in (HTML, MD, WIKI, TEX)]
    return B.Field.train([x for p in pages for x in B.lessons(p)])


@pytest.mark.parametrize(("kind", "body"), [("html", HTML), ("md", MD), ("wiki", WIKI), ("tex", TEX), ("escaped", HTML.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))])
def test_systems(kind, body):
    assert system(body) == kind
    page = leaves(body)
    labels = field().decode(B.page_features(page))
    assert {(y, B.text_of(x, y)) for x, y in zip(page, labels) if y != "drop" and B.text_of(x, y)} == WANT
    assert leaves(body.replace("\n", "\r\n")) == page


def test_inline_text_stays():
    text = "2 * 3 と snake_case と a < b と R&D と 50% と C# と f(x)"
    assert [(x.path, x.text) for x in leaves(f"# t\n\n{text}")][1] == ("md/p", text)
    assert leaves("[a](http://x \"t\")![i](j) \\*x\\*")[0].text.strip() == "a *x*"


def test_marginals_and_viterbi():
    from itertools import product

    rnd = np.random.default_rng(0)
    e, m = rnd.normal(size=(4, 3)), rnd.normal(size=(3, 3))
    paths = list(product(range(3), repeat=4))
    score = np.array([sum(e[k, y] for k, y in enumerate(p)) + sum(m[a, b] for a, b in zip(p, p[1:])) for p in paths])
    w = np.exp(score - score.max())
    w /= w.sum()
    one, two = B.marginals(e, m)
    want = np.zeros((4, 3))
    for p, x in zip(paths, w):
        for k, y in enumerate(p):
            want[k, y] += x
    assert np.allclose(one, want)
    assert np.isclose(two.sum(), 3)
    n = len(B.LABELS)
    f = B.Field(["a", "b"], rnd.normal(size=(2, n)), rnd.normal(size=(n, n)))
    page = [("a",), ("b",), ("a", "b")]
    best = max(product(range(n), repeat=3), key=lambda p: sum(f.scores(x)[y] for x, y in zip(page, p)) + sum(f.moves[a, b] for a, b in zip(p, p[1:])))
    assert f.decode(page) == [B.LABELS[y] for y in best]


def test_table(spark):
    rows = [(1, HTML), (2, None), (3, ""), (4, MD), (4, MD), (5, "ただの文"), (6, "<p>x" * 3000)]
    df = spark.createDataFrame(rows, "id bigint, body string").withColumnRenamed("id", "block_id")
    got = B.blocks(df, "block_id").collect()
    assert {(r["block_kind"], r["block_text"]) for r in got if r["block_id"] == 4} == WANT
    assert sum(r["block_id"] == 4 for r in got) == len(WANT)
    assert {r["block_text"] for r in got if r["block_id"] == 5} == {"ただの文"}
    assert {r["block_id"] for r in got} == {1, 4, 5, 6}
    assert B.blocks(df.where("false"), "block_id").count() == 0


def test_held_out(spark):
    """Pages of other words than those trained on are labelled as the teacher would."""
    f = field()
    other = [x.replace("本", "別の段落").replace("一", "項目です。") for x in (HTML, MD, WIKI, TEX)]
    for body in other:
        page = leaves(body)
        assert f.decode(B.page_features(page)) == [B.teacher(x) for x in page]


def test_long_front_matter():
    front = "---\ntitle: x\ntags:\n" + "".join(f"  - t{k}\n" for k in range(40)) + "\n---\n"
    assert leaves(front + MD)[0].path == "md/front" and leaves(front + MD)[1:] == leaves(MD)
    assert len(leaves("---\nnote: x\n" + "本文だ\n\n" * 40 + "---\n" + MD)) > len(leaves(MD))


def test_pages_whose_tags_say_nothing():
    """Blocks in bare containers, which the teacher calls paragraphs: the field tells them by their looks and order."""
    def page(k, tags):
        h, p, li, pre = tags
        words = ["記録", "音声", "辞書", "候補", "単語", "話者"]
        say = "".join(words[(k + i) % 6] + "を次の回へ移した。" for i in range(4))
        items = "".join(f"<{li}>- {words[(k * i) % 6]}{i}</{li}>" for i in range(1, 4))
        return f"<{h}>{words[k % 6]}の手順</{h}><{p}>{say}</{p}>{items}<{pre}>def f(x_{k}):\n    return x + {k};</{pre}><{p}>{say}</{p}>"

    field = B.Field.train([x for k in range(30) for x in B.lessons(leaves(page(k, ("h2", "p", "li", "pre"))))])
    got = want = told = 0
    for k in range(30, 60):
        truth = [B.teacher(x) for x in leaves(page(k, ("h2", "p", "li", "pre")))]
        bare = leaves(page(k, ("div", "div", "div", "div")))
        assert len(bare) == len(truth)
        want += len(truth)
        got += sum(a == b for a, b in zip(truth, field.decode(B.page_features(bare))))
        told += sum(a == B.teacher(x) for a, x in zip(truth, bare))
    assert got >= 0.95 * want and told < 0.5 * want


def test_residue_is_labelled_by_the_field():
    kinds = {x.path.rsplit("/", 1)[-1] for body in ("<!-- no --><p>x</p>", "---\na: b\n---\nx", "{{t|a}}\nx\n{|\n| y\n|}\n\n== h ==", "\\begin{document}\\begin{figure}z\\end{figure} x") for x in leaves(body)}
    assert {"comment", "front", "template", "table", "float"} <= kinds
    assert all(B.teacher(x) == "drop" for x in leaves("{{t|a}}\n\n== h ==")[:1])
