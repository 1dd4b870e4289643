from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kikiwake.llm import lookalike as L


@pytest.mark.parametrize(
    ("value", "form"),
    [("ﾏｲｸﾛﾎﾝ", "マイクロホン"), ("ＶＡＤ", "VAD"), ("VАD", "VAD"), ("マイク口ホン", "マイクロホン"), ("辞\u200b典", "辞典"), ("\u2007辞典\u3000", "辞典"), ("容量⾯", "容量面"), ("ﾊﾟｲﾌﾟ", "パイプ"), ("cafe\u0301", "café"), ("oﬃce", "office"), ("へイコウ", "ヘイコウ"), ("キュ一", "キュー"), ("変換表\U000e0101", "変換表"), ("発生カ", "発生力"), ("word\u00a0list", "word list"), ("ＣＯ２", "CO2")],
)
def test_same_look(value, form):
    assert L.look(value) == L.look(form)


@pytest.mark.parametrize(("a", "b"), [("パイアス", "バイアス"), ("じてん", "ジテン"), ("DECODER", "decoder"), ("CO₂", "CO2"), ("m²", "m2"), ("キャッシュー", "キャッシュ"), ("ヤ", "ャ"), ("Nº", "No")])
def test_other_look(a, b):
    assert L.look(a) != L.look(b)


def test_splicing_is_the_whole_string_form():
    p = L.segment_pattern(L.unstable_ranges())
    rnd = random.Random(1)
    chars = "aカﾊﾟﾞ゙゚é\u0301\u0308ñ力口一ー\u200b\u3000ＡАΑ²₂ﬃ⾯漢字\U000e0101けへ韓각\u1100\u1161\u11a8"
    for _ in range(4000):
        s = "".join(rnd.choices(chars, k=rnd.randrange(9)))
        assert L.look_spliced(s, p) == L.look(s), ascii(s)


def test_table(spark):
    values = spark.createDataFrame([("s", 1, "辞\u200b典", "w"), ("s", 1, "辞\u200b典", "w"), ("s", 2, "辞典", "w"), ("s", 3, None, "w"), ("s", 4, "", "w"), ("s", 5, "\u3000", "w"), ("s", 6, "辞\u200b典", "r"), ("s", 7, "x" * 100_000 + "\u200b", "w")], "field string, row_id bigint, value string, kind string")
    lex = spark.createDataFrame([("w", "辞典"), ("w", None)], "kind string, lex_form string")
    got = L.lookalikes(values.withColumn("look", F.lit(1)).drop("look"), lex)
    assert [tuple(r) for r in got.collect()] == [("s", 1, "辞典")]
    assert L.lookalikes(values.where("false"), lex).count() == 0
    assert L.lookalikes(values, lex.where("false")).count() == 0


def test_splicing_over_all_compositions():
    """Every canonical decomposition, apart and in a row, whatever the combining class of its second character."""
    import unicodedata

    p = L.segment_pattern(L.unstable_ranges())
    for o in range(0x30000):
        c = chr(o)
        if 0xD800 <= o < 0xE000 or not unicodedata.decomposition(c) or unicodedata.decomposition(c).startswith("<"):
            continue
        for s in (unicodedata.normalize("NFD", c), f"か{unicodedata.normalize('NFD', c)}x{c}"):
            assert L.look_spliced(s, p) == L.look(s), hex(o)
    for s in ("ো", "ொ", "ൊ", "ဦ", "ୋ", "ೊ", "ො"):
        assert L.look_spliced(s, p) == L.look(s)
