"""Caches, logs, sessions, nights, the lattice, and definitions in plain Python for what runs as expressions."""

from __future__ import annotations

import io
import random
import tracemalloc
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kikiwake.functions import reading as R
from kikiwake.operators import collect, diff, harvest, lattice, state, tokens
from kikiwake.session import Manifest, names_in, new_path, read_bucketed, write_bucketed
from kikiwake.sources import articles as A
from kikiwake.sources import logs
from kikiwake.streaming import Session, nightly
from kikiwake.types import LOOSE, VoiceSpec

ARTICLES = "article_idx bigint, id string, source string, body_kind string, body string, dedup boolean, trusted boolean"
SENTENCES = ["機械学習で意思決定を支援する仕組みを実装する", "要件と用件を整理してから設計に移行する作業だ"]


def folded(s):
    """A reading's long vowels, sign by sign."""
    out, before = "", ""
    for x in s:
        v = next((v for v, kana in R.VOWELS.items() if x in kana), "")
        if x == "ー":
            out += "ー" if before else ""
        elif x in R.ALONE and before and (before == v or (before, v) in (("E", "I"), ("O", "U"))):
            out += "ー"
        else:
            out, before = out + x, v
    return out


def test_long_vowels_are_the_fold(spark):
    rnd = random.Random(1)
    rows = [("".join(rnd.choices("アイウエオーカキクケコンソーaオウイ", k=rnd.randrange(12))),) for _ in range(3000)] + [("",), (None,)]
    from kikiwake.types import NormalizeOptions

    only = NormalizeOptions(dakuten=False, prolonged=True, sokuon=False, small=False)
    got = spark.createDataFrame(rows, "r string").select("r", R.normalize(F.col("r"), only).alias("n")).collect()
    assert all(x["n"] == (None if x["r"] is None else folded(x["r"])) for x in got)


def arts(spark, ids=(1, 2)):
    return spark.createDataFrame([(k, f"a{k}", "qiita", "Plain", SENTENCES[(k - 1) % 2], True, False) for k in ids], ARTICLES)


def run(spark, folder, seen=None, recognize=harvest.echo, ids=(1, 2)):
    seen = seen or spark.createDataFrame([], "article string, sentence string")
    return harvest.run_cached(arts(spark, ids), seen, [VoiceSpec("tts", "1"), VoiceSpec("tts", "3")], "m", folder, harvest.text_payload, recognize, tokens.char_tokens)


def test_second_run_is_all_cached(spark):
    folder = new_path(spark, "cache")
    first = run(spark, folder).metrics.first()
    again = run(spark, folder)
    second = again.metrics.first()
    assert (first["cells"], first["audio_hits"], first["asr_hits"]) == (4, 0, 0)
    assert (second["cells"], second["audio_hits"], second["asr_hits"], second["failures"]) == (4, 4, 4, 0)
    a, h = harvest.caches(spark, folder)
    assert a.count() == 4 and h.count() == 4  # nothing twice
    third = run(spark, folder, ids=(1, 2, 3)).metrics.first()  # article 3 says what 1 says: nothing new in this run
    assert third["cells"] == 4


def test_failures_are_not_kept_and_come_again(spark):
    folder = new_path(spark, "cache")

    def half(df):
        return df.withColumn("hypothesis", F.when(F.col("speaker") == "tts:1", F.col("text")))

    first = run(spark, folder, recognize=half)
    assert first.metrics.first()["failures"] == 2 and first.seen.count() == 0
    second = run(spark, folder)
    m = second.metrics.first()
    assert (m["audio_hits"], m["asr_hits"], m["failures"]) == (4, 2, 0) and second.seen.where("article is not null").count() == 2


def test_seen_is_appended_once(spark):
    path = new_path(spark, "seen")
    marks = spark.createDataFrame([("a", None), (None, "s"), ("a", None)], "article string, sentence string")
    for _ in range(2):
        state.append_seen(marks, logs.seen(spark, path), path)
    assert logs.json_lines(spark, path, "article string, sentence string").count() == 2


def test_archive_first_and_failures_by_item(spark):
    listing = spark.createDataFrame([(k, f'{{"slug":"s{k}","title":"t","path":"/p/{k}","liked_count":{k}}}') for k in range(4)] + [(9, '{"title":"none"}')], "seq int, payload string")
    path, asked = new_path(spark, "archive"), []
    A.archived(spark.createDataFrame([("s0", '{"article":{"body_html":"<p>old</p>"}}')], "slug string, payload string"), path)

    def fetch(df):
        asked.append({r["slug"] for r in df.collect()})
        return df.withColumn("payload", F.when(F.col("slug") != "s2", F.concat(F.lit('{"article":{"body_html":"<p>'), "slug", F.lit('</p>"}}'))))

    got = A.details(listing, state.stored(spark, path, "slug string, payload string"), fetch)
    items = {r["id"]: r["body"] for r in A.html_items(listing, got, 100, "https://h").collect()}
    assert items == {"s0": "<p>old</p>", "s1": "<p>s1</p>", "s3": "<p>s3</p>"} and asked[0] == {"s1", "s2", "s3"}
    assert A.archived(got, path) and state.stored(spark, path, "slug string, payload string").count() == 3
    assert not A.archived(got, "file:///proc/none/archive")


def test_json_numbers_and_documents(spark):
    rows = [("7", 7), ('"12"', 0), ("-1", 0), ("5000000000", 705032704), ("1.5", 0), ("true", 0), ("null", 0), ("18446744073709551616", 0), ("18446744073709551615", 4294967295)]
    df = spark.createDataFrame([(f'{{"n":{x}}}', w) for x, w in rows] + [("{}", 0), ("[", 0), (None, 0)], "p string, want bigint")
    assert all(r["got"] == r["want"] for r in df.select("*", A.count_or_zero(F.col("p"), "$.n").alias("got")).collect())
    doc = spark.createDataFrame([('{"terms":[{"word":"a"},{"word":5},{"count":1},{"word":"b"},7]}',), ("x\t1\n\n y \n",), ('{"terms":[]}',)], "c string")
    assert [r["w"] for r in doc.select(logs.dictionary_words(F.col("c")).alias("w")).collect()] == [["a", "b"], ["x", "y"], []]
    with pytest.raises(Exception, match="without terms"):
        spark.createDataFrame([('{"words":[]}',)], "c string").select(logs.dictionary_words(F.col("c"))).collect()


def test_session(spark):
    def pair(r, h):
        return spark.createDataFrame([(r, h)], "r string, h string").select(tokens.char_tokens(F.col("r"), {"機": "キ", "器": "キ"}).alias("reference"), tokens.char_tokens(F.col("h"), {"機": "キ", "器": "キ"}).alias("hypothesis"))

    s = Session(spark)
    assert s.dictionary().count() == 0
    s.add(pair("この機を", "この器を"))
    s.add(pair("犬を", "猫を"))
    again = Session(spark, s.path)
    again.add(pair("機は", "器は"))
    assert [tuple(r) for r in again.dictionary().collect()] == [("機", "キ", 2)]
    out, log = io.StringIO(), io.StringIO()
    again.save(out, log, "counts")
    assert out.getvalue() == "機\t2\n" and log.getvalue() == "犬\t猫\t犬\t猫\n"
    again.clear()
    assert again.dictionary().count() == 0 and Session(spark, s.path).rejects().count() == 0


def test_nightly(spark):
    folder, inbox = new_path(spark, "night"), new_path(spark, "inbox")
    table = spark.createDataFrame([(SENTENCES[1], SENTENCES[1].replace("用件", "要件"))], "text string, hypothesis string")
    lex = [("要件", "ヨウケン"), ("用件", "ヨウケン")]
    counts = []
    for ids in ((1, 2), (2, 3, 4)):
        arts(spark, ids).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(ARTICLES).parquet(inbox)
        merged = nightly(stream, folder, [VoiceSpec("tts", "1")], "m", harvest.text_payload, harvest.mapped(table), lambda c: tokens.lexicon_tokens(c, lex))
        counts.append([tuple(r) for r in merged.collect()])
    assert counts == [[(0, "用件", 1)], [(0, "用件", 1)]]  # what was seen doesn't come again


def test_positions(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5), ("え", 1)], "word string, count bigint")
    assert [tuple(r) for r in collect.positions(df).orderBy("pos").collect()] == [(0, "c", 5), (1, "a", 2), (2, "b", 2), (3, "え", 1)]


def test_manifest_and_buckets(spark):
    path = new_path(spark, "m")
    m = Manifest(spark, path, {"n": 0})
    other = Manifest(spark, path, {"n": 0})
    m.commit({"n": 1})
    with pytest.raises(FileExistsError):
        other.commit({"n": 7})
    assert Manifest(spark, path, {"n": 0}).state == {"n": 1} and names_in(spark, f"{path}/nothing") == []
    df = spark.createDataFrame([(f"k{k}", k) for k in range(50)], "k string, v int")
    seg = [write_bucketed(df, f"{path}/t", "k", 50, bucket_rows=5)]
    one = read_bucketed(spark, seg, "k string, v int", "k", df.where("k = 'k7'"))
    assert len(one.inputFiles()) == 1 and one.where("k = 'k7'").first()["v"] == 7 and read_bucketed(spark, seg, "k string, v int").count() == 50


def least(s, words):
    """Cheapest cut, by trying all."""
    best = None
    for n in range(len(s)):
        for at in combinations(range(1, len(s)), n):
            edges = [0, *at, len(s)]
            cost = 0.0
            for a, b in zip(edges, edges[1:]):
                w = s[a:b]
                run = len({lattice.kind(c) for c in w}) == 1 and (len(w) == 1 or lattice.kind(w[0]))
                whole = run and (b == len(s) or not lattice.kind(w[-1]) or lattice.kind(s[b]) != lattice.kind(w[-1]))
                cost += min(words[w][0] if w in words else 1e9, lattice.UNKNOWN + lattice.EACH * len(w) if whole else 1e9)
            best = min(best or (1e9, 99), (cost, n + 1))
    return best


def test_lattice(spark):
    rnd = random.Random(2)
    words = {w: (c, w) for w, c in (("音声", 7.0), ("音", 4.0), ("声", 4.0), ("認識", 5.0), ("声認", 2.0), ("識", 9.0), ("カナ", 3.0), ("カ", 1.0), ("の", 1.0))}
    for _ in range(300):
        s = "".join(rnd.choices("音声認識カナのa1", k=rnd.randrange(1, 8)))
        got = lattice.cut(s, words, 2)
        assert "".join(s[a:b] for a, b, _ in got) == s
        cost = sum(words[s[a:b]][0] if known else lattice.UNKNOWN + lattice.EACH * (b - a) for a, b, known in got)
        assert (cost, len(got)) == least(s, words)
    df = spark.createDataFrame([("音声 認識",), (None,), ("",), (" ",), ("ab12",), ("音" * 30_000,)], "t string")
    rows = [r["t"] for r in df.select(lattice.lattice_tokens(F.col("t"), [(w, w, c) for w, (c, _) in words.items()]).alias("t")).collect()]
    assert [x["surface"] for x in rows[0]] == ["音声", "認識"] and rows[1] is None and rows[2] == rows[3] == []
    assert [(x["surface"], x["pos"]) for x in rows[4]] == [("ab", "*"), ("12", "*")] and len(rows[5]) == 30_000


def test_lattice_of_many_texts_at_a_time():
    """Texts in one array are cut as each alone, and what is held at once grows with the longest text, not with their number."""
    rnd = random.Random(4)
    words = {w: (c, w + "よ") for w, c in (("音声", 7.0), ("声 認", 2.0), ("音", 4.0), ("カナ", 3.0), ("\n", 1.0), ("a1", 30.0), ("識\n音", 1.0))}
    texts = [None if k % 9 == 4 else "".join(rnd.choices("音声認識カナいa1 \n", k=rnd.randrange(30))) for k in range(400)]
    [got] = lattice.token_arrays(iter([pa.array(texts)]), words)
    for s, row in zip(texts, got.to_pylist()):
        assert row == (None if s is None else [{"surface": s[a:b], "reading": words[s[a:b]][1] if known else s[a:b].replace("い", "イ"), "pos": "名詞" if known else "*"} for a, b, known in lattice.cut(s, words, 3)])
    many = pa.array(["音声を認識して、語を数える。" * 70] * 2_000)
    next(lattice.token_arrays(iter([pa.array(["音"])]), words))
    tracemalloc.start()
    sizes = [(len(x), x.nbytes) for x in lattice.token_arrays(iter([many]), words)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for n, _ in sizes) == 2_000 and len(sizes) > 5 and max(b for _, b in sizes) < 20_000_000
    assert peak < 100_000_000  # a dict for each of their 1.7 million tokens takes over 300 MB


def test_diff_of_repeated_tokens():
    """As many equal tokens as a longest common subsequence has, over sequences full of repeats, losses and doublings."""
    rnd = random.Random(3)
    for _ in range(300):
        a = rnd.choices("abc", k=rnd.randrange(14))
        b = [x for x in a for _ in range(rnd.choice([0, 1, 1, 2]))] if rnd.random() < 0.5 else rnd.choices("abc", k=rnd.randrange(14))
        lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if a[i] == b[j] else max(lcs[i][j + 1], lcs[i + 1][j])
        ops = list(diff.opcodes(a, b))
        assert sum(y - x for t, x, y, *_ in ops if t == "equal") == lcs[-1][-1]
        assert [x for t, p, q, *_ in ops for x in a[p:q]] == a and [x for *_, p, q in ops for x in b[p:q]] == b
        assert LOOSE.prolonged
