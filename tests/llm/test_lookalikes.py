"""Consistent spelling by script sets."""

import pickle

from pyspark.sql import functions as F

from notegraph.llm.lookalikes import _ranges, confusable_kind, consistent_form, spelling
from tests.test_looks import DIFFERENT, SAME


def test_same_and_different(spark):
    f = spelling(spark).form
    for a, b in SAME:
        assert f(a) == f(b) and f(f(b)) == f(b), (a, b)
    for a, b in DIFFERENT:
        assert f(a) != f(b), (a, b)


def test_spelled_in_one_script(spark):
    f = spelling(spark).form
    assert f("Узeл") == "Узел" and f("сосо") == "coco" and f("ロボ") == "ロボ" and f("口") == "口"
    assert f("Ηλιος") == "Ηλιος" and f("한글 메모") == "한글 메모" and f("") == ""
    assert f("ꓮBC") == "ABC" and f("x" * 10_000 + "е") == "x" * 10_000 + "e"


def test_script_sets(spark):
    s = spelling(spark)
    assert s.scripts.of("a") == {"Latin"} and s.scripts.of("ж") == {"Cyrillic"} and "Common" in s.scripts.of("1")
    assert {"Hiragana", "Katakana"} <= s.scripts.of("ー")  # Script_Extensions, not Script
    assert s.resolved("漢かカ") == {"Jpan"} and s.resolved("한漢") == {"Kore"} and s.resolved("aж") == set() and s.resolved("1") is None
    assert pickle.loads(pickle.dumps(s)).form("Узeл") == "Узел"
    assert _ranges("[\\-a-c\\u00E9\\U0001F600-\\U0001F601]") == [(45, 45), (97, 99), (0xE9, 0xE9), (0x1F600, 0x1F601)]


def test_columns(spark):
    df = spark.createDataFrame([("Узeл",), ("сосо",), ("flow ",), (None,), ("",), ("ｆlow",), ("VISA카드",)], "v string")
    got = [tuple(r) for r in df.select(consistent_form(spark, F.col("v")), confusable_kind(spark, F.col("v"))).collect()]
    assert got == [("Узел", "mixed-script"), ("coco", "whole-script"), ("flow", "none"), (None, None), ("", "none"), ("flow", "none"), ("VISA카드", "none")]
