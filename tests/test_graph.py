"""Resolution, the build and the catalogue on small vaults."""

import pytest
from pyspark.sql import functions as F

from notegraph.operators.closure import all_pairs, reach
from notegraph.operators.resolve import case_collisions, duplicate_names, link_keys, resolve
from notegraph.plans import build as B
from notegraph.plans import catalog as Q


def paths(spark, *p):
    return spark.createDataFrame([(x,) for x in p], "path string")


def landed(spark, files, *asked):
    links = spark.createDataFrame(list(asked), "src string, target string")
    got = {(r["src"], r["target"]): r["landed"] for r in resolve(links, paths(spark, *files)).collect()}
    return [got[a] for a in asked]


FILES = ["Root.md", "a/Note.md", "b/Note.md", "b/sub/Note.md", "b/x/Deep.md", "img/pic.png", "img/No.013 stone.md", "c/한글.md", "d/Other.md"]


def test_resolve(spark):
    assert landed(
        spark, FILES,
        ("d/s.md", "Root"), ("d/s.md", "none"), ("d/s.md", "Note"), ("b/s.md", "Note"), ("b/sub/s.md", "Note"), ("s.md", "Note"), ("b/x/s.md", "Note"),
        ("d/s.md", "b/Note"), ("d/s.md", "sub/Note"), ("d/s.md", "ub/Note"), ("d/s.md", "pic.png"), ("d/s.md", "img/pic.png"), ("d/s.md", "Note.md"), ("d/s.md", "b/Note.md"),
        ("d/s.md", "No.013 stone"), ("d/s.md", "한글"), ("bb/s.md", "Note"), ("d/s.md", ""), (None, "Note"),
    ) == [
        "Root.md", None, "a/Note.md", "b/Note.md", "b/sub/Note.md", "a/Note.md", "a/Note.md",
        "b/Note.md", "b/sub/Note.md", None, "img/pic.png", None, "a/Note.md", None, "img/No.013 stone.md", "c/한글.md", "a/Note.md", None, "a/Note.md",
    ]


def test_resolve_keeps_repeats_and_empty_inputs(spark):
    links = spark.createDataFrame([("a.md", "Note", 1), ("a.md", "Note", 1), ("a.md", None, 2)], "src string, target string, landed_at int")
    got = resolve(links, paths(spark, "x/Note.md")).collect()
    assert sorted((r["landed_at"], r["landed"]) for r in got if r["landed"]) == [(1, "x/Note.md")] * 2 and len(got) == 3
    assert resolve(links, paths(spark)).filter("landed IS NULL").count() == 3
    assert resolve(links.limit(0), paths(spark, "x/Note.md")).count() == 0


def test_keys_and_names(spark):
    assert {(r["key"], r["path"]) for r in link_keys(paths(spark, "a/b/N.md", "p.png")).collect()} == {("N.md", "a/b/N.md"), ("N", "a/b/N.md"), ("b/N", "a/b/N.md"), ("a/b/N", "a/b/N.md"), ("p.png", "p.png")}
    files = paths(spark, "a/N.md", "b/N.md", "c/n.md", "p.png", "q/P.md")
    assert {r["key"]: r["paths"] for r in duplicate_names(files).collect()} == {"N.md": ["a/N.md", "b/N.md"], "N": ["a/N.md", "b/N.md"]}
    assert {r["key"] for r in duplicate_names(files, notes_only=True).collect()} == {"N"}
    assert sorted(r["names"] for r in case_collisions(files).collect()) == [["N", "n"], ["N.md", "n.md"]]


NOTES = {
    "A.md": "---\ntype: concept\ntags:\n  - Stack/Python\n  - Stack\nbuilds_on:\n  - \"[[B|b]]\"\n  - gone\n---\n[[C]] [[pic.png]] [[secret]] [[A]]",
    "z/B.md": "---\ntype: hub\nbuilds_on:\n  - C\nsupersedes:\n  - A\n---\n`[[A]]`",
    "z/z.md": "folder note",
    "z/q/C.md": "---\nbuilds_on:\n  - D\n  - B\n---\n",
    "z/q.md": "beside",
    "z/q/D.md": "x",
    "800 TRPG/secret.md": "---\ntype: item\n---\n[[A]]",
    "800 TRPGx/ok.md": "",
    "CLAUDE.md": "[[A]]",
}


@pytest.fixture(scope="module")
def graph(spark):
    notes = spark.createDataFrame([*NOTES.items(), (None, "x"), ("null.md", None)], "path string, text string")
    g = B.build(notes, paths(spark, *NOTES, "img/pic.png"))
    return B.Graph(g.node.cache(), g.edge.cache(), g.tag.cache())


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_build(graph):
    assert rows(graph.node.select("path")) == [(p,) for p in sorted(["A.md", "z/B.md", "z/z.md", "z/q/C.md", "z/q.md", "z/q/D.md", "800 TRPGx/ok.md"])]
    a = graph.node.filter("path = 'z/q/C.md'").first()
    assert (a["name"], a["zone"], a["dir"], a["type"], a["bytes"]) == ("C", "z", "z/q", None, len(NOTES["z/q/C.md"]))
    assert graph.node.filter("path = 'A.md'").first()["zone"] == "A.md"
    assert sorted((r["src"], r["dst"] or "", r["raw"], r["kind"]) for r in graph.edge.collect()) == sorted([
        ("A.md", "z/B.md", "B", "builds_on"), ("A.md", "", "gone", "builds_on"), ("A.md", "z/q/C.md", "C", "links_to"), ("A.md", "", "secret", "links_to"), ("A.md", "A.md", "A", "links_to"),
        ("z/B.md", "z/q/C.md", "C", "builds_on"), ("z/B.md", "A.md", "A", "supersedes"), ("z/q/C.md", "z/q/D.md", "D", "builds_on"), ("z/q/C.md", "z/B.md", "B", "builds_on"),
        ("z/B.md", "z/z.md", "z", "part_of"), ("z/q.md", "z/z.md", "z", "part_of"), ("z/q/C.md", "z/q.md", "q", "part_of"), ("z/q/D.md", "z/q.md", "q", "part_of"),
    ])
    assert rows(graph.tag) == [("A.md", "Stack"), ("A.md", "Stack/Python")]


def test_written_graph(spark, graph, tmp_path):
    graph.write(str(tmp_path / "g"))
    graph.write(str(tmp_path / "g"))
    again = B.open_graph(spark, str(tmp_path / "g"))
    assert rows(Q.stats(again)) == rows(Q.stats(graph)) == [("kind", "builds_on", 5), ("kind", "links_to", 3), ("kind", "part_of", 4), ("kind", "supersedes", 1), ("total", "edge", 13), ("total", "node", 7), ("total", "tag", 2), ("total", "unresolved", 2)]


def test_catalogue(graph):
    assert rows(Q.by_type(graph, "concept")) == [("A.md",)]
    assert rows(Q.by_tag(graph, "Stack")) == [("A.md",)] and rows(Q.by_tag(graph, "Stac")) == []
    assert [tuple(r) for r in Q.learning_path(graph, "A.md").collect()] == [("z/B.md", 1), ("z/q/C.md", 2), ("z/q/D.md", 3)]
    assert rows(Q.learning_path(graph, "A.md", 1)) == [("z/B.md", 1)] and rows(Q.learning_path(graph, "nowhere")) == []
    assert rows(Q.orphans(graph)) == [("800 TRPGx/ok.md",)]
    assert rows(Q.orphans_legacy(graph)) == [("800 TRPGx", "800 TRPGx/ok.md")]
    assert rows(Q.find(graph, "C")) == [("z/q/C.md",)] and rows(Q.find(graph, "nope")) == []
    assert rows(Q.tag_exact(graph, "Stack")) == [("A.md", 1)]
    assert rows(Q.sql(graph, "SELECT count(*) AS n FROM edge")) == [(13,)]
    near = rows(Q.near(graph, "z/B.md").select("rel", "path"))
    assert near == [("linked_by", "A.md"), ("linked_by", "z/q/C.md"), ("links_to", "A.md"), ("links_to", "z/q/C.md"), ("links_to", "z/z.md")]
    assert [r["path"] for r in Q.path_legacy(graph, "z/B.md").collect()] == ["z/B.md", "z/q/C.md", "z/q/D.md"]
    assert ("zone", "z", 5) in rows(Q.stats_legacy(graph)) and ("type", "(none)", 5) in rows(Q.stats_legacy(graph))
    assert rows(Q.near_scored(graph, "A.md")) == [("A.md", 6, "backlink,link"), ("z/q/C.md", 3, "link")]


def test_unresolved_by_target(spark, graph):
    assert rows(Q.unresolved_by_target(graph, paths(spark, "800 TRPG/secret.md"))) == [("excluded", 1), ("other", 1)]


def test_closures(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", None), ("d", "d")], "src string, dst string")
    assert rows(reach(edges, "a")) == [("b", 1), ("c", 1)]
    assert rows(all_pairs(edges)) == sorted([(x, y) for x in "abc" for y in "abc"] + [("d", "d")])
    assert rows(all_pairs(edges.limit(0))) == []


def test_shared_tags_are_ranked(spark):
    node = spark.createDataFrame([(p,) for p in "abcd"], "path string")
    edge = spark.createDataFrame([("a", "d", "d", "links_to")], "src string, dst string, raw string, kind string")
    tag = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "x"), ("c", "y"), ("d", "x")], "path string, tag string")
    got = [(r["path"], r["n"]) for r in Q.near(B.Graph(node, edge, tag), "a").filter(F.col("rel") == "shares_tag").collect()]
    assert got == [("c", 2), ("b", 1)]
