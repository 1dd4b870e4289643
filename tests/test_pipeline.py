from __future__ import annotations

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from kikiwake import sinks, streaming
from kikiwake.operators import collect, diff, evaluate, extract, harvest, pipeline, state, tokens
from kikiwake.sources import articles, logs
from kikiwake.types import ARTICLE, LENIENT, STRICT, TOKENS, ExtractOptions, VoiceSpec

WORDS = {"今日は機械を学ぶ": "今日/キョウ は/ハ 機械/キカイ を/ヲ 学ぶ/マナブ", "今日は機会を学ぶ": "今日/キョウ は/ハ 機会/キカイ を/ヲ 学ぶ/マナブ", "化学の本": "化学/カガク の/ノ 本/ホン", "科学の本": "科学/カガク の/ノ 本/ホン", "猫が鳴く": "猫/ネコ が/ガ 鳴く/ナク", "犬が鳴く": "犬/イヌ が/ガ 鳴く/ナク"}
SENT_A = "機械学習で意思決定を支援する仕組みを実装する"
SENT_B = "要件と用件を整理してから設計に移行する作業だ"


def toks(s):
    return [(a, b, "名詞") for a, b in (x.split("/") for x in s.split())]


def test_four_pairs(spark):
    pairs = [("今日は機械を学ぶ", "今日は機会を学ぶ")] * 2 + [("化学の本", "科学の本"), ("猫が鳴く", "犬が鳴く")]
    df = spark.createDataFrame([(k, r, h) for k, (r, h) in enumerate(pairs)], "seq int, ref string, hyp string")
    table = spark.createDataFrame([(k, toks(v)) for k, v in WORDS.items()], f"sentence string, tokens {TOKENS}")
    both = tokens.table_tokens(tokens.table_tokens(df, "ref", table, "reference"), "hyp", table, "hypothesis").select("seq", "reference", "hypothesis")
    out = pipeline.process(both)
    danger, rejects = collect.danger(out, ["seq", "block_idx"]), collect.rejects(out)
    assert [(r["word"], r["reading"], r["count"]) for r in collect.ranked(danger).collect()] == [("機械", "キカイ", 2), ("化学", "カカク", 1)]
    assert rejects.count() == 1
    text = io.StringIO()
    sinks.write_dictionary(danger, text)
    assert text.getvalue() == "機械\n化学\n"
    text = io.StringIO()
    sinks.write_dictionary(danger, text, counts=True)
    assert text.getvalue() == "機械\t2\n化学\t1\n"
    text = io.StringIO()
    sinks.write_dictionary(danger, text, "json", schema="s", field="f", generator="g")
    want = {"schema": "s", "version": 1, "field": "f", "generator": "g", "terms": [{"word": "機械", "count": 2}, {"word": "化学", "count": 1}]}
    assert text.getvalue() == json.dumps(want, indent=2, ensure_ascii=False) + "\n"
    text = io.StringIO()
    sinks.term_document(danger.where("false"), "s", "f", "g", text)
    assert json.loads(text.getvalue())["terms"] == [] and text.getvalue().endswith("}\n")
    assert {r["kind"] for r in pipeline.process_rows(both).collect()} == {"equal", "homophone", "non-homophone"}


@pytest.mark.parametrize(("a", "b", "strict", "want"), [("機械/キカイ", "機会/キカイ", False, True), ("猫/ネコ", "犬/イヌ", False, False), ("実装/ジッソウ", "失踪/シッソウ", False, True), ("実装/ジッソウ", "失踪/シッソウ", True, False), ("形態素/ケイタイソ", "形態/ケイタイ 素/ソ", False, True)])
def test_classify(spark, a, b, strict, want):
    df = spark.createDataFrame([(toks(a), toks(b))], f"reference {TOKENS}, hypothesis {TOKENS}")
    out = pipeline.process(df, opts=STRICT) if strict else pipeline.process(df)
    assert [r["is_homophone"] for r in out.collect()] == [want]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_diff_is_an_lcs():
    rnd = random.Random(3)
    for _ in range(1500):
        a, b = (rnd.choices("abcd", k=rnd.randrange(12)) for _ in range(2))
        m = diff.matches(a, b)
        assert len(m) == lcs(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x < u and y < v for (x, y), (u, v) in zip(m, m[1:]))
        ops = list(diff.opcodes(a, b))
        assert [x for t, i, j, k, n in ops for x in a[i:j]] == a and [x for t, i, j, k, n in ops for x in b[k:n]] == b
        assert all(s[0] != t[0] for s, t in zip(ops, ops[1:]))


def one_article(spark, kind, body, **kw):
    row = {"article_idx": 0, "id": "a", "source": "s", "title": "", "url": "", "popularity": 0, "body_kind": kind, "body": body, "dedup": True, "trusted": False} | kw
    return spark.createDataFrame([tuple(row.values())], ARTICLE)


def texts(df):
    return [r["text"] for r in df.orderBy("article_idx", "sent_idx").collect()]


@pytest.mark.parametrize(
    ("kind", "body", "want"),
    [
        ("Markdown", f"# 見出し\n\n{SENT_A}。\n```\n{SENT_B}。\n```\n", [SENT_A]), ("Markdown", f"> {SENT_A}。{SENT_A}。", [SENT_A]), ("Markdown", f"| {SENT_A} |\n- {SENT_B}。", [SENT_B]),
        ("Html", f"<p>{SENT_A}。</p><pre>{SENT_B}。</pre>", [SENT_A]), ("Plain", f"{SENT_A}。short。{SENT_B}！", [SENT_A, SENT_B]), ("Plain", None, []), ("Plain", "", []), ("Markdown", f"{SENT_A}（。{SENT_B}。", [SENT_B]),
    ],
)
def test_extract(spark, kind, body, want):
    assert texts(extract.extract(one_article(spark, kind, body))) == want


def test_lengths_and_cap(spark):
    body = "。".join("漢" * n for n in (19, 20, 80, 81))
    assert [len(x) for x in texts(extract.extract(one_article(spark, "Plain", body)))] == [20, 80]
    many = "。".join("漢" * 20 + "かな" * k for k in range(1, 8))
    assert [len(x) for x in texts(extract.extract(one_article(spark, "Plain", many), ExtractOptions(max_per_article=2)))] == [22, 24]
    assert texts(extract.extract(one_article(spark, "Plain", "短い。x_y。"), LENIENT)) == ["短い", "x_y"]


def votes(spark, rows):
    return spark.createDataFrame(rows, "speaker string, reference_surface string, hypothesis_surface string, is_homophone boolean").withColumn("reference_reading", F.lit("r")).withColumn("hypothesis_reading", F.lit("r"))


def test_votes(spark):
    df = votes(spark, [("a", "x", "y", True), ("b", "x", "y", True), ("a", "x", "y", True), ("a", "x", "z", True), ("a", "p", "q", False), (None, "x", "z", True)])
    v = collect.pair_votes(df)
    assert {(r["hypothesis_surface"], r["speakers"], r["outcomes"]) for r in v.collect()} == {("y", 2, 3), ("z", 1, 2)}
    assert tuple(collect.vote_summary(v, 2).first()) == (1, 1)
    assert collect.passed(df, 2).count() == 4
    assert collect.dropped(v, 2).count() == 1


READ = {"機": "キ", "械": "カイ", "会": "カイ", "実": "ジツ", "装": "ソウ", "犬": "イヌ", "猫": "ネコ", "を": "ヲ"}


def test_harvest(spark):
    kai, hyp = "機械を実装、", "機会を実装。"
    rows = [(0, "a", "s", "", "", 0, "Plain", f"{kai}\n犬と猫", True, True), (1, "b", "s", "", "", 0, "Plain", kai, True, True), (2, "c", "f", "", "", 0, "Plain", "", False, True)]
    arts = spark.createDataFrame(rows, ARTICLE)
    seen = spark.createDataFrame([], "article string, sentence string")
    asr = spark.createDataFrame([(kai, hyp), ("犬と猫", "猫と猫")], "text string, hypothesis string")
    none_a, none_h = spark.createDataFrame([], "audio_key string, payload binary"), spark.createDataFrame([], "asr_key string, hypothesis string")
    run = harvest.run(arts, seen, [VoiceSpec("tts", "1"), VoiceSpec("tts", "2")], "m", none_a, none_h, harvest.text_payload, harvest.mapped(asr), lambda c: tokens.char_tokens(c, READ), min_votes=2)
    assert [(r["word"], r["count"]) for r in run.danger.collect()] == [("械", 2)]
    assert run.rejects.count() == 2
    m = run.metrics.first()
    assert (m["sentences"], m["cells"], m["audio_hits"], m["failures"]) == (2, 4, 0, 0)
    assert {r["article"] for r in run.seen.where("article is not null").collect()} == {"s/a", "s/b"}
    again = harvest.pending(arts, run.seen)
    assert again.count() == 0
    broken = harvest.run(arts, seen, [VoiceSpec("tts", "1")], "m", none_a, none_h, harvest.text_payload, harvest.per_partition(lambda: lambda row: 1 / 0, "hypothesis", "string"), lambda c: tokens.char_tokens(c, READ))
    assert broken.metrics.first()["failures"] == 2 and broken.seen.where("sentence is not null").count() == 0


@pytest.mark.parametrize(("points", "want"), [([(0, 0.9), (25, 0.5), (50, 0.1)], None), ([(0, 0.5), (25, 0.5), (50, 0.5)], 0), ([(0, 0.9), (25, 0.3), (50, 0.295), (75, 0.295)], 25), ([(0, 0.9)], None)])
def test_plateau(spark, points, want):
    df = spark.createDataFrame(points, "n int, rate double")
    rec = evaluate.plateau(df, 0.01, 2)
    assert rec.first()["recommended_n"] == want
    assert evaluate.final_n(df, rec).first()["final_n"] == (want if want is not None else points[-1][0])
    assert evaluate.plateau(df, 0.01, 0).first()["recommended_n"] is None


@pytest.mark.parametrize(("n", "cap", "step", "want"), [(9, 100, 3, [0, 3, 6, 9]), (2, 100, 1, [0, 1, 2]), (0, 10, 5, [0]), (7, 5, 2, [0, 2, 4, 5]), (3, 9, 0, [0, 1, 2, 3])])
def test_schedule(spark, n, cap, step, want):
    assert sorted(r["n"] for r in evaluate.schedule(spark, n, cap, step).collect()) == want


def test_sweep(spark):
    words = spark.createDataFrame([(0, "械"), (1, "犬")], "pos int, word string")
    pts = evaluate.schedule(spark, 2, 9, 1)
    assert {(r["n"], tuple(r["words"])) for r in evaluate.bias_words(pts, words).collect()} == {(0, ()), (1, ("械",)), (2, ("械", "犬"))}
    out = spark.createDataFrame([(0, True), (1, False)], "n int, is_homophone boolean")
    assert sorted(tuple(r) for r in evaluate.curve(pts, out, 1).collect()) == [(0, 1, 1.0), (1, 0, 0.0), (2, 0, 0.0)]
    assert [r["word"] for r in evaluate.pruned(words, words.limit(1), words.where("false"), 1).collect()] == ["械"]


def test_logs_and_sources(spark, tmp_path):
    (tmp_path / "refs.jsonl").write_text('{"audio":"k","text":"a"}\nbroken\n{"audio":"k","text":"b"}\n{"audio":"z"}\n')
    assert [(r["audio"], r["text"]) for r in logs.refs(spark, str(tmp_path / "refs.jsonl")).collect()] == [("k", "a")]
    assert logs.seen(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "d.txt").write_text(" 機械\t3\n\n犬\n犬\n")
    assert [r["word"] for r in logs.dictionary(spark, str(tmp_path / "d.txt")).orderBy("pos").collect()] == ["機械", "犬", "犬"]
    (tmp_path / "d.json").write_text('{"terms":[{"word":"x","count":1},{"count":2},{"word":"y"}]}')
    assert [r["word"] for r in logs.dictionary(spark, str(tmp_path / "d.json")).orderBy("pos").collect()] == ["x", "y"]
    (tmp_path / "c.tsv").write_text("a\t1\nb\nc\t2\t3\n")
    assert [tuple(r) for r in logs.counts(spark, str(tmp_path / "c.tsv")).collect()] == [("a", 1)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("一行\n二行\n")
    assert [(r["id"], r["body"], r["trusted"], r["dedup"]) for r in articles.files(spark, str(tmp_path / "t")).collect()] == [("x.txt", "一行\n二行\n", True, False)]
    assert [r["text"] for r in logs.text_lines(spark, str(tmp_path / "t")).orderBy("line_no").collect()] == ["一行", "二行"]
    items = spark.createDataFrame([(0, '{"id":"a","title":5,"stocks_count":2,"likes_count":9,"body":"b"}'), (1, '{"title":"t"}'), (2, "nope")], "seq int, payload string")
    assert [(r["id"], r["title"], r["popularity"]) for r in articles.markdown_items(items, 10).collect()] == [("a", "", 9)]
    listing = spark.createDataFrame([(0, '{"slug":"s","title":"t","path":"/p","liked_count":4}'), (1, '{"slug":"u"}'), (2, "{}")], "seq int, payload string")
    details = spark.createDataFrame([("s", '{"article":{"body_html":"<p>x</p>"}}'), ("u", '{"article":{"body_html":" "}}')], "slug string, payload string")
    assert [(r["id"], r["url"], r["popularity"], r["body"]) for r in articles.html_items(listing, details, 9, "https://h").collect()] == [("s", "https://h/p", 4, "<p>x</p>")]


def test_appends_are_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    for _ in range(2):
        state.append_absent(rows, str(tmp_path / "log"), "k")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_line_pairs(spark):
    ref = logs.numbered_lines(spark.createDataFrame([("f", "a\n\nc\nd")], "k string, t string"), "k", "t")
    hyp = logs.numbered_lines(spark.createDataFrame([("f", "x\n　\n\n")], "k string, t string"), "k", "t")
    assert [(r["reference"], r["hypothesis"]) for r in pipeline.paired_lines(ref, hyp, "k").orderBy("line_no").collect()] == [("a", "x"), ("c", "")]


def test_streams(spark, tmp_path):
    data = [("x", True), ("x", True), ("y", False)]
    spark.createDataFrame(data, "reference_surface string, is_homophone boolean").write.parquet(str(tmp_path / "in"))
    stream = streaming.source(spark, str(tmp_path / "in"), "reference_surface string, is_homophone boolean")
    got = streaming.to_memory(streaming.running_dictionary(stream), "words", "complete")
    assert [tuple(r) for r in got.collect()] == [("x", 2)]
    first = streaming.first_sentences(stream.select(F.col("reference_surface").alias("text")))
    q = streaming.catch_up(first.select("sentence"), streaming.log_sink(str(tmp_path / "log"), "sentence"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_lexicon_tokens(spark):
    df = spark.createDataFrame([("機械を学ぶ",), (None,), ("",)], "t string")
    got = df.select(tokens.lexicon_tokens(F.col("t"), [("機械", "キカイ"), ("機", "キ")]).alias("x")).collect()
    assert [t["surface"] for t in got[0]["x"]] == ["機械", "を", "学", "ぶ"] and got[0]["x"][1]["reading"] == "ヲ"
    assert got[1]["x"] is None and got[2]["x"] == []
