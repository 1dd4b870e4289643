from __future__ import annotations

import pytest

from kikiwake.llm import sentences as S


@pytest.fixture(scope="module")
def model():
    texts = ["見出し\n\n一つ目の文だ。二つ目の文だ！？三つ目か？「引用文だ。」次の文。", "Dr. Kerrigo wrote it. It began at 1 a.m. on the bench. See No. 5 of 1.304 rows, etc. Then more.", "担当は「中の文だ。もう一つ。」と書いた。次。", "ทดสอบข้อความ อีกประโยค Abc 12 คำ", "Am 4. Mai galt es. Danach kam es.", "“Stop it now!” said J. K. Roe. Next one.", "문장이다. 다음 문장이다! 끝.", "यह वाक्य है। दूसरा वाक्य है। डॉ. Roe ने कहा।", "長い文が次の回へ持ち越した　次の文が記録を別の表に移した　終わりの文もまた記録を移した"]
    texts += [t.replace("。", "。 ").replace("」 ", "」") for t in texts]
    return S.EventModel.train(x for t in texts * 5 for x in S.seed_streams(t))


def cut(model, text):
    return [text[a:b] for a, b in S.units(text, model)]


@pytest.mark.parametrize(
    "parts",
    [
        ["一つ目の文だ。", "二つ目の文だ！？", "三つ目か？"], ["比率は２３．３１倍だ。", "Ver.1.5では動く。"], ["担当は「中だ！外だ。」と書き残した。", "次だ。"], ["「全部引用だ。」", "次だ。"], ["It began at 1 a.m. on the bench.", "Dr. Kerrigo wrote it."],
        ["There are 804 takes, etc.", "Then more."], ["Am 4. Mai galt es.", "Danach kam es."], ["“Stop it now!” said J. K. Roe.", "Next one."], ["그는 말했다.", "다음이다!"], ["यह एक वाक्य है।", "दूसरा वाक्य है।"],
    ],
)
def test_units(model, parts):
    for space in (" ", "\n"):
        assert cut(model, space.join(parts)) == parts


def test_blocks_and_unmarked(model):
    assert cut(model, "見出し\n \nab\ncd\n\n　字下げの文。\r\n\r\n- 項目") == ["見出し", "ab\ncd", "字下げの文。", "- 項目"]
    assert cut(model, "ทดสอบข้อความ อีกประโยค Abc 12 คำ") == ["ทดสอบข้อความ", "อีกประโยค Abc 12 คำ"]
    a, b = "記録を別の表に移したので早めに終わった", "次の回へ持ち越したのでまだ終わらない"
    assert cut(model, f"{a}　{b}") == [a, b]


def test_posteriors_are_exact(model):
    """Forward-backward against the sum over all placements of boundaries."""
    from itertools import product

    symbols, at, _ = S.stream("一つ。二つ！三つ？四つ。五", "")
    total, with_b = 0.0, [0.0] * len(at)
    for choice in product((0, 1), repeat=len(at)):
        seq, marks = [], dict(zip(at, choice))
        for k, x in enumerate(symbols):
            seq.append(x)
            if marks.get(k):
                seq.append(S.BOUNDARY)
        p = 1.0
        for k in range(1, len(seq)):
            p *= model.p(*seq[max(0, k - 2) : k + 1])
        total += p
        for n, c in enumerate(choice):
            with_b[n] += p * c
    assert model.posteriors(symbols, at) == pytest.approx([x / total for x in with_b])


def test_table(spark):
    rows = [(1, "一つ。二つ。"), (2, None), (3, ""), (4, " \n "), (5, "一つ。二つ。"), (6, "長い文だ。" * 5000)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = S.sentences(df.withColumn("start_pos", df["id"]), "id").groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {1: 2, 5: 2, 6: 5000}
    assert S.sentences(df.where("false"), "id").count() == 0


def test_script_of_the_whole_text():
    assert S.unmarked("a" * 200_000 + "\n\n" + "ทดสอบ" * 60_000, []) == "th"


def test_pairs_around_stray_openers():
    assert S._matched("「一（二［三（四。五」六") == {0: 10, 10: 0}


def test_abbreviations_are_learned():
    """One that no list has, seen with small letters behind it, ends no sentence before a capital either, unlike in the seed."""
    texts = [f"The plan holds, exempl. as in case {k}. It was read at noon.\n\nWe saw it. Then we left." for k in range(8)]
    texts += [f"They met exempl. Kerrigo on day {k}. He came late." for k in range(4)]
    m = S.learn(texts)
    assert "exempl" in m.known and "noon" not in m.known
    assert cut(m, "They met exempl. Kerrigo there. He left.") == ["They met exempl. Kerrigo there.", "He left."]
    seed = [g.boundary for g in S.gaps("They met exempl. Kerrigo there.", "", m.known)]
    assert seed == [True]


def test_stretches_without_marks():
    """Boundaries between words, and between characters, where no mark and no space is left."""
    ja, en = ["記録を移した", "次の回を待つ", "音声を聞いた", "辞書を直した"], ["the note was read", "we moved the list", "they heard a voice", "nobody came back"]
    texts = ["".join(ja[(k + i) % 4] + "。" for i in range(4)) + "\n\n" + " ".join(en[(k * 3 + i) % 4].capitalize() + "." for i in range(4)) for k in range(12)]
    m = S.learn(texts)
    w = S.WordModel.learn(texts, m)
    for parts, sep in ((ja, ""), (en, " ")):
        run = sep.join([*parts, *parts[::2], *parts[1::2], *parts])
        got = [run[a:b] for a, b in S.units(run, m, w)]
        assert got == [*parts, *parts[::2], *parts[1::2], *parts]
    assert list(S.units(ja[0] + ja[1], m, w)) == [(0, 12)]  # no longer than sentences are: left to the marks
    assert [x for a, b in S.units("（" + "".join(ja * 4) + "）", m, w) for x in (a, b)] == [0, 98]


def test_long_words_brackets_and_prefixes(model):
    deep = "「" * 60 + "中だ。" + "」" * 60
    assert cut(model, f"彼は{deep}と書いた。次。") == [f"彼は{deep}と書いた。", "次。"]
    word = "a" * 300
    assert cut(model, f"See {word}.{word} here. Next one.") == [f"See {word}.{word} here.", "Next one."]
    assert S._word("x" * 5000, 5000) == "x" * 5000
    assert S._after("ab. " + "März" + "z" * 100, 3) == "_Up"


def test_all_texts_are_learned_from(spark):
    """No text is left out: counts, abbreviations and the longest sentence are those of the whole table."""
    texts = [f"Note {k} came, as said. It was read by J. K. Roe on the {k % 7 + 1}. Mai there.\n\nWe saw it. Then we left." for k in range(3_300)]
    texts[7::1_100] = ["The plan holds, exempl. as in case. Dr. No went etc. Then more."] * 3
    want, got = S.learn(texts), S.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert got.known == want.known == {"exempl"} and got.counts == want.counts
    assert sum(n for g, n in got.counts.items() if g == ("<s>",)) == 2 * 3_297 + 3


def test_stretches_by_the_words_of_all_texts(spark):
    """The table does as models in memory do; a stretch doesn't set the length that it is measured by, in small tables either."""
    ja = ["記録を移した", "次の回を待つ", "音声を聞いた", "辞書を直した"]
    texts = ["".join(ja[(k + i) % 4] + "。" for i in range(4)) for k in range(12)]
    run = "".join([*ja, *ja[::2], *ja[1::2], *ja])
    texts.append(run)
    got = S.sentences(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id").where("id = 12").orderBy("start_pos").collect()
    m = S.learn(texts)
    assert [(r["start_pos"], r["end_pos"]) for r in got] == list(S.units(run, m, S.WordModel.learn(texts, m)))
    assert [run[r["start_pos"] : r["end_pos"]] for r in got] == [*ja, *ja[::2], *ja[1::2], *ja]
