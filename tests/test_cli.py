from __future__ import annotations

import io

import pytest
from pyspark.sql import functions as F

from kikiwake import cli
from kikiwake.operators import harvest


@pytest.fixture
def files(tmp_path):
    (tmp_path / "r").write_text("機械を実装\n犬と猫\n\n余り\n")
    (tmp_path / "h").write_text("機会を実装\n猫と猫\n\n")
    (tmp_path / "lex").write_text("機\tキ\n械\tカイ\n会\tカイ\n犬\tイヌ\n猫\tネコ\n")
    return tmp_path


def test_batch(spark, files):
    args = ["--tokenizer", str(files / "lex"), "batch", str(files / "r"), str(files / "h"), "--output", str(files / "out"), "--reject", str(files / "rej"), "--counts"]
    assert cli.main(args) == 0
    assert (files / "out").read_text() == "械\t1\n"
    assert (files / "rej").read_text() == "犬\t猫\tイヌ\tネコ\n"


def test_harvest(spark, files):
    (files / "in").mkdir()
    (files / "in" / "a.txt").write_text("機械を実装。犬と猫。\n")
    (files / "asr").write_text("機械を実装\t機会を実装\n")
    common = ["--tokenizer", str(files / "lex"), "harvest", str(files / "in")]
    assert cli.main([*common, "--asr", str(files / "asr"), "--voice", "1", "--voice", "2", "--output", str(files / "out")]) == 0
    assert (files / "out").read_text() == "械\n"


def test_dry_run(spark, files, capsys):
    (files / "in").mkdir()
    (files / "in" / "a.txt").write_text("一つ。二つ。\n")
    assert cli.main(["harvest", str(files / "in"), "--dry-run"]) == 0
    assert capsys.readouterr().out == "一つ\n二つ\n"


def test_sweep(spark):
    words = spark.createDataFrame([(0, "械"), (1, "犬")], "pos int, word string")
    refs = spark.createDataFrame([("k1", "機械を実装")], "audio string, text string")
    hear = lambda df: df.withColumn("hypothesis", F.when(F.array_contains("words", "械"), "機械を実装").otherwise("機会を実装"))
    lex = [("機", "キ"), ("械", "カイ"), ("会", "カイ")]
    curve, rec, pruned = cli.sweep(spark, words, refs, hear, lambda c: cli.tokens.lexicon_tokens(c, lex), 1, 9, 0.01, 1)
    assert sorted(tuple(r) for r in curve.collect()) == [(0, 1, 1.0), (1, 0, 0.0), (2, 0, 0.0)]
    assert rec.first()[0] == 1
    assert [r["word"] for r in pruned.collect()] == ["械"]
    with pytest.raises(ValueError, match="no references"):
        cli.sweep(spark, words, refs.where("false"), harvest.echo, cli.tokens.char_tokens, 1, 9, 0.01, 1)


def test_repl_and_diff(spark):
    seen = []
    lex = [("機", "キ"), ("械", "カイ"), ("会", "カイ")]
    cut = lambda c: cli.tokens.lexicon_tokens(c, lex)
    n = cli.repl(spark, io.StringIO("機械\n機会\n機械\n機会\nodd\n"), cut, lambda d, r: seen.append([tuple(x) for x in d.collect()]))
    assert n == 2 and seen == [[("械", "カイ", 1)], [("械", "カイ", 2)]]
    rows = cli.diff_text(spark, "機械\n\n", "機会\n", cut).collect()
    assert [(r["kind"], r["surface"]) for r in rows] == [("equal", "機"), ("homophone", "械")]
