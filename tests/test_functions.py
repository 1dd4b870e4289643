from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from kikiwake.functions import keys as K
from kikiwake.functions import reading as R
from kikiwake.functions import text as X
from kikiwake.types import LOOSE, STRICT, NormalizeOptions


def run(spark, values, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", f(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["k"])]


@pytest.mark.parametrize(
    ("a", "b", "strict", "loose"),
    [("ケイタイ", "ケータイ", False, True), ("コウコウ", "コーコー", None, True), ("トオリ", "トーリ", None, True), ("ジッソウ", "シッソウ", None, True), ("ガッコウ", "ガコウ", None, True), ("キャク", "キヤク", None, True), ("キカイ", "キカク", None, False), ("ハシ", "ハナ", None, False)],
)
def test_reading_pairs(spark, a, b, strict, loose):
    x, y = run(spark, [a, b], lambda c: R.normalize(c, LOOSE))
    assert (x == y) is loose
    if strict is not None:
        x, y = run(spark, [a, b], lambda c: R.normalize(c, STRICT))
        assert (x == y) is strict


def test_reading_exact(spark):
    assert run(spark, ["けいたい"], lambda c: R.normalize(c, STRICT)) == ["ケイタイ"]
    assert run(spark, ["カガク", "イシ", "ガッコウ", "", None, "ーア", "ンー"], R.normalize) == ["カカク", "イシ", "カコー", "", None, "ア", "ン"]
    assert run(spark, ["形態", "ゔ"], R.to_katakana) == ["形態", "ヴ"]


def slow_normalize(s, o):
    vowels = {k: v for v, ks in R.VOWELS.items() for k in ks}
    out, before = "", None
    for c in s.translate(str.maketrans(R.HIRAGANA, R.KATAKANA)):
        if o.dakuten:
            c = dict(zip(R.VOICED, R.PLAIN)).get(c, c)
        if o.small:
            c = dict(zip(R.SMALL, R.FULL)).get(c, c)
        if o.sokuon and c == "ッ":
            continue
        if o.prolonged:
            v = vowels.get(c)
            if c == "ー":
                out += "ー" if before else ""
                continue
            if c in R.ALONE and before and (before == v or (before, v) in (("E", "I"), ("O", "U"))):
                out += "ー"
                continue
            before = v
        out += c
    return out


@pytest.mark.parametrize("o", [LOOSE, STRICT, NormalizeOptions(False, True, False, True), NormalizeOptions(True, True, False, False)])
def test_normalize_against_loop(spark, o):
    rnd = random.Random(5)
    chars = R.KATAKANA + R.HIRAGANA + "ー漢a ッ"
    values = ["".join(rnd.choices(chars, k=rnd.randrange(12))) for _ in range(400)]
    assert run(spark, values, lambda c: R.normalize(c, o)) == [slow_normalize(v, o) for v in values]


def test_white_space(spark):
    assert run(spark, ["機械 学習　で\t実装", None, " "], X.without_space) == ["機械学習で実装", None, ""]
    assert run(spark, ["　a b\x85", ""], X.trim) == ["a b", ""]
    assert run(spark, ["a\r\nb\n", "", "a\n\n", "x"], X.lines) == [["a", "b"], [], ["a", ""], ["x"]]


def test_punct(spark):
    assert run(spark, ["し、解答率を。", "バージョン1.5,です"], X.strip_punct) == ["し解答率を", "バージョン1.5,です"]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("a\n```\ncode\n```\nb", "a\nb"), ("a\n~~~\nx\n```\nb\n```\nc", "a\nb\n"), ("a\n  ```py\nrest", "a\n"), ("| a | b |\nx", "x"), ("## h\n> > q\n- i\n12. n\n> | t", "h\nq\ni\nn\n| t"),
        ("[t](u)![a](b)[c] [d](", "t[c] [d]("), ("[a ![b](c)](d)", "a ![b](d)"), ("見て https://e.x/a_b?c=1 よ", "見て  よ"), ("`a` **b**", "a b"),
    ],
)
def test_markdown(spark, body, want):
    got = run(spark, [body], X.strip_markdown)[0]
    assert got.rstrip("\n") == want.rstrip("\n")


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<p>a</p>b<br>c", "a\nb\nc"), ("<script>x</p></script>a", "a"), ("<pre>x", ""), ("a <code>b</code> c", "a b c"), ("a < b", "a < b"), ("<!-- x -->a", "a"), ("&lt;&amp;lt;&copy;", "<&lt;&copy;"), ("<STYLE>p{}</Style  >z", "z"), ("<prefix>a</prefix>", "a"),
    ],
)
def test_html(spark, body, want):
    assert run(spark, [body], X.strip_html) == [want]


def test_sentences_and_filters(spark):
    assert run(spark, ["あ。い！う？\n　え \n。", "", None], X.split_sentences) == [["あ", "い", "う", "え"], [], None]
    assert run(spark, ["（あ", "あ）（", "「あ」", "(a)", "a)("], X.unbalanced) == [True, True, False, False, True]
    assert run(spark, ["a..b", "http", "普通の文", "a_b", "追[記]"], X.has_residue) == [True, True, False, True, True]
    assert run(spark, ["漢字かな a", "", "  "], X.japanese_ratio) == [0.8, 0.0, 0.0]


def test_keys(spark):
    def slow(*parts):
        h = hashlib.sha256()
        for p in parts:
            h.update(len(p.encode()).to_bytes(8, "little") + p.encode())
        return h.hexdigest()

    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("文", "")], "a string, b string")
    assert [r["k"] for r in df.select(K.content_key(F.col("a"), F.col("b")).alias("k")).collect()] == [slow("ab", "c"), slow("a", "bc"), slow("文", "")]
    one = spark.range(1)
    assert one.select(K.rate_key(F.lit(0.9))).first()[0] == "0.900"
    a, b = one.select(K.biased_key(F.lit("x"), F.lit("m"), F.array().cast("array<string>")), K.asr_key(F.lit("x"), F.lit("m"))).first()
    assert a == b
