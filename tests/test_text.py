"""String functions against Python."""

import hashlib
import unicodedata

import regex
from pyspark.sql import functions as F

from textloom.functions.text import (BYTE_DST, PRETOKEN_PATTERN, PRETOKEN_REGEX, byte_level, byte_level_decode, chars,
                                     md5_prefix, nfkc, pretokens, py_strip, sp_normalize, sp_pretokens)

SAMPLES = ["", " ", "  a b  ", "\t\nx\x0b\x0c\r", "\x1c\x1d\x1ey\x1f", " z\u0085", "　w  ",
           "​keep​", "ﬁ ligature", "①２３", "한국어 텍스트", "日本語のテキスト", "emoji 😀 ok",
           "é combining", "it's they'll we've I'm", "a  b\n\nc\t d", "trailing   ", "x\n"]


def test_strip_matches_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", py_strip("s").alias("t")).collect()}
    assert got == {i: s.strip() for i, s in enumerate(SAMPLES)}


def test_pretokens_match_python_regex(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", pretokens("s").alias("t")).collect()}
    for i, s in enumerate(SAMPLES):
        p = s if (s == "" or s.startswith(" ")) else " " + s
        assert got[i] == regex.findall(PRETOKEN_PATTERN, p), s
        assert "".join(got[i]) == p


def test_byte_level_roundtrip_and_alphabet(spark):
    assert len(set(BYTE_DST)) == 256 and " " not in BYTE_DST
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    rows = df.select("s", byte_level("s").alias("b"), byte_level_decode(byte_level("s")).alias("d"),
                     F.size(chars(byte_level("s"))).alias("n")).collect()
    for r in rows:
        assert r.d == r.s and r.n == len(r.s.encode("utf-8"))


def test_nfkc_and_md5(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    for r in df.select("s", nfkc("s").alias("n"), md5_prefix("s", 16).alias("h")).collect():
        assert r.n == unicodedata.normalize("NFKC", r.s)
        assert r.h == hashlib.md5(r.s.encode()).hexdigest()[:16]


def test_sentencepiece_pieces_keep_everything(spark):
    texts = ["a\nb\tc  d", "Straße  ﬁne", "e\u0301te\u0323x 12é3", " \n ", "日本語のテキスト한국어mixedРус", "x\u0301\u0302-- !?\u0000end"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select("s", sp_normalize("s").alias("n"), sp_pretokens(sp_normalize("s")).alias("p")).collect()
    for r in rows:
        want = " ".join(unicodedata.normalize("NFKC", r.s).casefold().split())
        assert r.n == (" " + want if want else ""), r.s
        assert "".join(r.p).replace("▁", " ") == r.n, r.s
    assert rows[0].p == ["▁a", "▁b", "▁c", "▁d"]
    assert rows[4].p == ["▁日本語", "の", "テキスト", "한국어", "mixed", "рус"]
