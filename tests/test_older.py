"""The older reading of notes."""

from notegraph.plans import older


def notes(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def test_lint(spark):
    texts = {
        "a.md": "---\ntype: two words\nsummary: " + "s" * 81 + "\ncreated: 2026-13-99\nbuilds_on:\n  - [[x/b]]\n  - gone\n  - b\n  - a\n---\n[[b]] [[x/b.md]] [[gone|y]] [[TODO]] [[예시]] color #6B4E8C end",
        "x/b.md": "no frontmatter [[gone]]",
        "900 Archive/z.md": "[[gone]]",
    }
    df = notes(spark, texts)
    got = [tuple(r) for r in older.lint(df, df.select("path")).orderBy("path", "seq").select("path", "code", "detail").collect()]
    assert got == [
        ("a.md", "type 없음", ""), ("a.md", "summary 81자 (상한 80)", "s" * 40 + "…"), ("a.md", "created 형식 오류", "2026-13-99"), ("a.md", "builds_on 4개 (상한 3)", ""),
        ("a.md", "builds_on 미해결", "gone"), ("a.md", "의도치 않은 태그", "#6B4E8C"), ("a.md", "link", "gone"),
        ("x/b.md", "frontmatter 없음", ""), ("x/b.md", "link", "gone"),
    ]
    every = older.lint(df, df.select("path"), show_all=True)
    assert {r["detail"] for r in every.filter("code = 'link'").collect()} == {"gone", "TODO", "예시"}
    assert every.filter("path = '900 Archive/z.md'").count() == 2


def test_build(spark):
    texts = {"p/A.md": "---\nbuilds_on:\n  - B|x\n---\n[[q/B]] [[z/q/C]] [[u/B]] [[#h]] #S/t `#no/x`", "q/B.md": "[[none]]", "r/q.md": "", "z/q/C.md": "", "900 Archive/B.md": "", "CLAUDE.md": ""}
    graph, meta = older.build(notes(spark, texts))
    got = sorted((r["src"], r["dst"] or "", r["raw"], r["kind"]) for r in graph.edge.collect())
    assert got == sorted([
        ("p/A.md", "q/B.md", "B|x", "builds_on"), ("p/A.md", "q/B.md", "q/B", "links_to"), ("p/A.md", "z/q/C.md", "z/q/C", "links_to"), ("p/A.md", "q/B.md", "u/B", "links_to"),
        ("q/B.md", "", "none", "links_to"), ("q/B.md", "r/q.md", "q", "part_of"), ("z/q/C.md", "r/q.md", "q", "part_of"),
    ])
    assert [tuple(r) for r in graph.tag.collect()] == [("p/A.md", "S/t")]
    assert {r["k"] for r in meta.collect()} == {"built", "excluded"}
