import re

import pytest
from pyspark.sql import functions as F

from lineweave.functions import text as X


def value(spark, expression, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in sorted(rows.select("i", expression(F.col("v"))).collect())]


def test_keys(spark):
    assert value(spark, X.match_key, " a　\x1c", None, "") == ["a", "", ""]
    assert value(spark, X.plain_key, "<b>你</b>{n}\\n好\r\n ", "a<1") == ["你好", "a<1"]
    assert value(spark, X.punctuation_key, "……，；：") == ["......,;:"]
    assert value(spark, X.comparison_key, "<b>你</b>{n}\\n好 ") == ["你{n}好"]
    assert value(spark, X.loose_key, "诶, <i>A</i>-1!") == ["欸a1"]


def test_brackets(spark):
    assert value(spark, X.breath_key, "(喘)你(a(b))好", "(a", "（a)", "x") == ["你好", "(a", "（a)", "x"]
    assert value(spark, X.tail_key, "你好 (a) （b）", "(a)你好", "你好(a", "(a)(b)", "你(x)好") == ["你好", "(a)你好", "你好(a", "", "你(x)好"]


@pytest.mark.parametrize(("text", "start", "end", "expected"), [("\n a \n", False, False, " a "), ("a", True, True, "\na\n"), (" a\n", True, True, "\n a\n"), ("\n", False, True, "")])
def test_edge_newlines(spark, text, start, end, expected):
    assert value(spark, lambda c: X.align_newlines(c, F.lit(start), F.lit(end)), text) == [expected]


def test_options_tags_speakers(spark):
    assert value(spark, X.option_parts, "1. 好 2. 不好", "A、x B、y C、z", "1. a", "2. a 1. b", "pre 1. a 2. b") == [["好", "不好"], ["x", "y", "z"], [], [], []]
    assert value(spark, X.balanced_tags, "<color=#1>a</color>", "<color=#1>a", "</ruby>", None) == [True, False, False, True]
    assert value(spark, X.speaker_variants, "旁白", "主角", "A (B)", None) == [[], ["@player"], ["a", "a(b)", "b"], []]


def test_ratios():
    assert X.lcs_similarity("abcd", "abxd") == 0.75
    assert X.lcs_similarity("", "") == 1.0
    assert X.sequence_ratio("abcd", "abcd") == 1.0


def test_business_key(spark):
    rows = spark.createDataFrame([("12", "story_text_1_Dialog_Detail_v0"), ("k", "story_text_1_a"), ("", "free text")], "k string, c string")
    assert [r[0] for r in rows.select(X.business_key(F.col("k"), F.col("c"))).collect()] == ["story_text_1_Dialog_Detail_v0", "k", ""]
    assert re.match(X.STORY_KEY, "story_text_1_Dialog_Detail_v0")


def test_strip_takes_what_the_pattern_takes(spark):
    ends = [chr(c) for c in (*range(0x21), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x1FFF, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    rows = [(e + " x" + e + "y\n" + e,) for e in ends] + [("",), (" \n\u3000",), (None,)]
    got = spark.createDataFrame(rows, "t string").select("t", X.strip(F.col("t")), F.regexp_replace("t", f"^{X.BLANK}+|{X.BLANK}+$", ""))
    assert all(a == b for _, a, b in got.collect())
    # a pattern over every character took seconds here
    assert "RegExpReplace" not in spark.range(1).select(X.strip(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
