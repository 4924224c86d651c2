"""Text that reads the same has one form; text that reads differently does not."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from notegraph.functions.looks import link_part, look_form, looks

SAME = [
    ("flow", "ｆｌｏｗ"),
    ("Déjà", unicodedata.normalize("NFD", "Déjà")),
    ("회고", unicodedata.normalize("NFD", "회고")),
    ("Helimabehi", "Heli\u200bmabehi"),
    ("a b", "a\u00a0b"),
    ("a b", "a\u3000b"),
    ("a-b", "a\u2011b"),
    ("a-b", "a－b"),
    ("office", "oﬃce"),
    ("Kobidoki", "Коbіdоkі"),
    ("Kelvin", "\u212aelvin"),
    ("Ångström", "\u212bngström"),
    ("Узел", "Узeл"),
    ("feguke", "feɡuke"),
    ("pausa", "рausа"),
    ("Übersicht", "Übеrsіcht"),
    ("x", "x "),
    ("", "\u200b"),
    ("ABC", "ꓮBC"),
    ("一", "⼀"),
    ("IV", "Ⅳ"),
    ("it's", "it’s"),
    ("口", "ロ"),
]
DIFFERENT = [("Ångström", "Angström"), ("A", "a"), ("x2", "x²"), ("step 1", "step ①"), ("I", "l"), ("O", "0"), ("ab", "a b"), ("rn", "m"), ("ţ", "ț"), ("hora", "нога")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(spark, a, b):
    assert looks(spark).form(a) == looks(spark).form(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(spark, a, b):
    assert looks(spark).form(a) != looks(spark).form(b)


def test_columns(spark):
    df = spark.createDataFrame([("Узeл",), ("Узел",), ("сосо",), ("flow ",), (None,), ("",), ("ｆlow",)], "v string")
    got = [r[0] for r in df.select(look_form(spark, F.col("v"))).collect()]
    assert got[0] == got[1] and got[2:] == ["coco", "flow", None, "", "flow"]
    assert df.select(link_part(F.lit(" a\\|b"))).first()[0] == "a"
