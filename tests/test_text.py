"""The text functions on literal inputs."""

import pytest
from pyspark.sql import functions as F

from notegraph.functions import legacy
from notegraph.functions import text as T


def run(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


FM = "type: concept\ntags:\n  - Stack/Python\n  - Lang\nsummary: \"a: b\"\ncreated:\nbuilds_on:\n  - '[[A|x]]'\n  - B"


def test_frontmatter(spark):
    texts = ["---\na: 1\n---\nbody", "no", "---\na\n---\nb\n---\nc", "x\n---\na\n---", "---\n---\n", "---\na: 1\n----\nz", None]
    assert run(spark, T.frontmatter, *texts) == ["a: 1", None, "a", None, None, "a: 1", None]
    assert run(spark, T.body, *texts) == ["body", "no", "b\n---\nc", "x\n---\na\n---", "---\n---\n", "-\nz", None]


def test_scalars(spark):
    get = lambda k: run(spark, lambda c: T.fm_get(c, k), FM)[0]
    assert (get("type"), get("summary"), get("created"), get("none"), get("ype")) == ("concept", "a: b", None, None, None)
    assert run(spark, lambda c: T.fm_get(c, "a"), "a:   ", 'a: ""', "a:  x y ", "b: 1\na: 2\na: 3", "a: x\u2028y", None) == ["", "", "x y", "2", "x\u2028y", None]


def test_lists(spark):
    items = lambda k, fm=FM: run(spark, lambda c: T.fm_list(c, k), fm)[0]
    assert items("tags") == ["Stack/Python", "Lang"]
    assert items("builds_on") == ["A|x", "B"]
    assert items("none") == [] and items("tags", "tags: [a, b]") == [] and items("tags", "tags:\nx: 1") == []
    assert items("tags", None) == []


@pytest.mark.parametrize(
    "raw,target",
    [("A", "A"), ("A|x", "A"), ("A\\|x", "A"), ("A#h", "A"), ("A#h|x", "A"), ("A^b", "A"), ("d/A", "d/A"), (" A ", "A"), ("#h", ""), ("|x", ""), ("\u00a0A\u3000", "A")],
)
def test_link_target(spark, raw, target):
    assert run(spark, T.link_target, raw) == [target]


def test_code_and_links(spark):
    assert run(spark, T.strip_code, "a\n```py\n[[X]]\n```\nb `[[Y]]` c", "~~~\nx", "a `b` `c` d", "x") == ["a\n\n\n\nb  c", "\n", "a   d", "x"]
    text = "[[A]] ![[B]] \\[[C]] [[#h]] [[D|x]] [[E\\|y]] `[[F]]`\n```\n[[G]]\n```\n[[A]] \\![[H]]"
    assert run(spark, T.links, text, "", None) == [["A", "B", "D", "E", "A", "H"], [], None]


def test_body_tags(spark):
    assert run(spark, T.body_tags, "#tag and #한글 #a/b", "](#x) a#b # h \\#c C#/F #123 `#d`", "#ffa #1a") == [["tag", "한글", "a/b"], [], ["ffa", "1a"]]


def test_dates(spark):
    good = ["2026-08-10", "20260810", "2024-02-29", "2026-W33", "2026-W33-1", "2026W331", "2020-W53-7"]
    bad = ["2026-8-1", "2026-13-99", "2023-02-29", "2026", "2026-08-10T10:00", " 2026-08-10", "0000-01-01", "2021-W53-1", "2026-W33-8", "", "+12026-08-10"]
    assert run(spark, T.is_iso_date, *good) == [True] * len(good)
    assert run(spark, T.is_iso_date, *bad) == [False] * len(bad)


def test_paths_and_forms(spark):
    assert run(spark, T.path_name, "a/b.v1.md", "x.md", "a/p.png") == ["b.v1", "x", "p.png"]
    assert run(spark, T.path_zone, "a/b.md", "x.md") == ["a", "x.md"]
    assert run(spark, T.path_dir, "a/b/c.md", "x.md") == ["a/b", ""]
    assert run(spark, lambda c: T.under(c, ["800 T"]), "800 T", "800 T/a", "800 TX/a") == [True, True, False]
    assert run(spark, T.is_hidden, ".a/b", "a/.b", "a/b") == [True, True, False]
    assert run(spark, T.nfc, "한글", "e\u0301", "abc", None) == ["한글", "é", "abc", None]
    assert run(spark, T.casefold, "Straße", "ABC", None) == ["strasse", "abc", None]


def test_legacy(spark):
    assert run(spark, lambda c: legacy.fm_list(c, "k"), "k:\n  - [[A]]\n  - \"B\"", "k: x")[0] == ["A", "B"]
    blocks = run(spark, legacy.fm_blocks, "a: 1\ntags:\n  - x\nRead Status: y\nb: 2")[0]
    assert [(b["key"], b["block"]) for b in blocks] == [("a", "a: 1"), ("tags", "tags:\n  - x\nRead Status: y"), ("b", "b: 2")]
    assert run(spark, legacy.strip_code, "```\na\n~~~\nb\n```\nc", "  ~~~\nx\n~~~\ny `z`") == ["\n\n\n\n\nc", "\n\n\ny "]
    assert run(spark, legacy.link_target, "A\\|x", "A\\", "e\u0301#x") == ["A", "A", "é"]
    assert run(spark, legacy.junk_tags, "color #6B4E8C here", "#tag #other", "#729651 x", "[E](#ec2-a) y", "z #Stack/Py") == [["#6B4E8C"], [], [], [], []]
    assert run(spark, legacy.nested_tags, "#Stack/Python #flat #한글/가") == [["Stack/Python", "한글/가"]]
    assert run(spark, legacy.is_placeholder, "{x}", "${y}", "<z>", "day NN", "note") == [True, True, True, True, False]
    assert run(spark, lambda c: legacy.is_skill_ref(c, ["sk"]), "sk", "sk/SKILL.md", "sk/x", "y/SKILL") == [True, True, False, False]
    assert run(spark, legacy.bad_name, "a:b", "ok") == [True, False]
    warn = lambda c: legacy.routing_warning(c, F.lit("log"), {"A/sub": ["hub"]}, {"A": ["log"], "B": ["hub"]})
    assert run(spark, warn, "A/sub/x.md", "A/x.md", "B/x.md", "C/x.md") == ["A/sub", None, "B", None]
    assert run(spark, legacy.raw_links, "[[a|b]] ![[c]] [[d\ne]]") == [["a|b", "c"]]
    assert run(spark, lambda c: legacy.is_template(c, F.lit("type: template")), "x.md") == [True]
