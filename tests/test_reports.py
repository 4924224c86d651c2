"""Lint, measurements, snapshots, triples, the source and the command line."""

import io
import json
import os
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from notegraph import cli
from notegraph.plans import author, lint, measure, older, rdf, snapshot
from notegraph.plans.build import Graph
from notegraph.sources.vault import decoded, folder_names, read_vault
from notegraph.streaming.relint import stream_findings

GOOD = "---\ntype: log\ncreated: 2026-08-10\n---\n"


def lines(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def vault(spark, notes):
    df = spark.createDataFrame(list(notes.items()), "path string, text string")
    return df, df.select("path")


def test_every_rule(spark):
    fm = "---\ntype: nope\nsummary: " + "s" * 81 + "\ncreated: 2026-13-99\nbuilds_on:\n  - a\n  - b\n  - c\n  - dead\n---\n#tag [[dead]] [[dead]]"
    notes, targets = vault(spark, {"x.md": fm, "a.md": GOOD, "b.md": GOOD, "c.md": "---\ntype: case\n---\n", "z/d.md": "text"})
    got = [tuple(r) for r in lint.lint(notes, targets).orderBy("path", "seq").select("path", "seq", "code", "detail").collect()]
    assert got == [
        ("c.md", 0, "summary missing", ""), ("c.md", 1, "created missing", ""),
        ("x.md", 0, "type unknown", "nope"), ("x.md", 1, "summary too long", "81자"), ("x.md", 2, "builds_on too many", "4개"), ("x.md", 3, "created invalid", "2026-13-99"),
        ("x.md", 4, "body tag", "tag"), ("x.md", 5, "builds_on unresolved", "dead"), ("x.md", 6, "link unresolved", "dead"), ("x.md", 7, "link unresolved", "dead"),
        ("z/d.md", 0, "type missing", ""), ("z/d.md", 1, "created missing", ""),
    ]
    found = lint.lint(notes, targets)
    assert lines(lint.broken_targets(found), "target", "n") == [("dead", 2)]
    assert ("link unresolved", 2) in lines(lint.summary(found), "code", "n")
    assert lint.exit_code(found) == 1 and lint.exit_code(found.limit(0)) == 0
    assert '"file":"x.md"' in "".join(r[0] for r in lint.report_json(found).collect())


def test_exemptions_are_independent(spark):
    notes, targets = vault(spark, {"p/x.md": "[[dead]] #t", "px/y.md": "[[dead]]", "f.md": "[[other]]"})
    codes = lambda r: {(a, b) for a, b in lines(lint.lint(notes, targets, r), "path", "code")}
    everything = codes(lint.Rules())
    assert codes(lint.Rules(skip_unresolved_from=["p"])) == everything - {("p/x.md", "link unresolved")}
    assert codes(lint.Rules(skip_unresolved_to=["other"])) == everything - {("f.md", "link unresolved")}
    assert codes(lint.Rules(skip_frontmatter_in=["p"])) == {x for x in everything if x[0] != "p/x.md" or x[1] == "link unresolved"}
    assert codes(lint.Rules(skip_files=["f.md"])) == {x for x in everything if x[0] != "f.md"}


def test_rules_file(tmp_path):
    assert lint.load_rules(str(tmp_path)) == lint.Rules()
    (tmp_path / lint.CONFIG_NAME).write_text('{"skip_files": ["a.md"], "unknown": 1}')
    assert lint.load_rules(str(tmp_path)) == lint.Rules(skip_files=["a.md"])


def test_measures(spark):
    notes, targets = vault(spark, {"a/x.md": "---\ntype: concept\nsummary: abc\nbuilds_on:\n  - b|c\n---\n[[y]] ``z`` [[none]]", "900 Archive/y.md": "---\nsummary: abcde\n---\n~~~~\n[[x]]\n~~~~", "b.md": "---\ntags:\n\n  - x\nsummary: a\n---\n"})
    f = {(s, m): n for s, m, n in lines(measure.fields(notes), "scope", "measure", "n")}
    assert (f["all", "files"], f["zone", "files"], f["all", "summary"], f["all", "builds_on items"], f["all", "blank line in a block"]) == (3, 2, 3, 1, 1)
    assert tuple(measure.summary_lengths(notes).first()) == (1, 3, 5, 5, 0)
    m = {(s, k): n for s, k, n in lines(measure.links(notes), "scope", "measure", "n")}
    assert (m["all", "links"], m["all", "listed edges that are cut"], m["all", "notes with double ticks"], m["all", "notes with ~~~"], m["all", "notes with longer fences"]) == (2, 1, 1, 1, 1)
    r = {(s, k): n for s, k, n in lines(measure.resolution(notes, targets), "scope", "measure", "n")}
    assert (r["all", "links"], r["all", "unresolved"], r["all", "edges"], r["all", "edges unresolved"]) == (2, 1, 1, 0)
    assert lines(measure.unresolved_targets(notes, targets), "target", "n") == [("none", 1)]
    assert dict(lines(measure.names(targets), "measure", "n")) == {"duplicate names": 0, "duplicate files": 0, "case collisions": 0, "names not in NFC": 0}
    assert lines(measure.type_histogram(notes), "type", "n", "known") == [("concept", 1, True)]


def test_snapshots(spark):
    head = spark.createDataFrame([("a.md", 44), ("b.md", 12), ("c.md", 9), ("gone.md", 3), ("p.txt", 50)], "path string, lines int")
    work = spark.createDataFrame([("a.md", 14), ("b.md", 6), ("c.md", 1), ("p.txt", 1)], "path string, lines int")
    files = spark.createDataFrame([("d/.x.md.icloud",), ("a.md",)], "path string")
    assert lines(snapshot.doctor(head, work, files), "check", "path", "detail") == [("missing", "gone.md", ""), ("placeholder", "d/.x.md.icloud", "d/x.md"), ("shrunk", "a.md", "44 -> 14")]
    assert lines(snapshot.gate(head, work), "check", "path") == [("deleted", "gone.md"), ("shrunk", "a.md")]
    texts = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\r\nb\rc\n\n",)], "t string")
    assert [r[0] for r in texts.select(snapshot.line_count(F.col("t"))).collect()] == [0, 1, 1, 4]


@pytest.fixture
def triples(spark):
    node = spark.createDataFrame([("a b/x.md", "concept", 'q"\\\n', "2026-01-01"), ("y.md", "hub", None, "")], "path string, type string, summary string, created string")
    edge = spark.createDataFrame([("a b/x.md", "y.md", "y", "builds_on"), ("a b/x.md", None, "z", "links_to")], "src string, dst string, raw string, kind string")
    tag = spark.createDataFrame([("y.md", "S/P/q"), ("y.md", "S")], "path string, tag string")
    return rdf.triples(Graph(node, edge, tag))


def test_triples(spark, triples):
    got = set(lines(triples, "s", "p", "o"))
    assert ("urn:vault:note/a%20b/x.md", "urn:vault:builds_on", "urn:vault:note/y.md") in got and len(got) == 9
    assert lines(rdf.read_n_triples(rdf.n_triples(triples)), *rdf.COLUMNS) and set(map(str, lines(rdf.read_n_triples(rdf.n_triples(triples)), *rdf.COLUMNS))) == set(map(str, lines(triples, *rdf.COLUMNS)))
    found = rdf.match(triples, ("?a", rdf.RDF_TYPE, "?k"), ("?a", "urn:vault:builds_on", "?b"))
    assert lines(found, "k", "b") == [("urn:vault:type/concept", "urn:vault:note/y.md")]
    maybe = rdf.optional(rdf.match(triples, ("?a", rdf.RDF_TYPE, "?k")), rdf.match(triples, ("?a", "urn:vault:summary", "?t")))
    assert {r["a"][-4:]: r["t"] for r in maybe.collect()} == {"x.md": 'q"\\\n', "y.md": None}
    assert rdf.match(triples, ("?a", "urn:vault:builds_on", "?a")).count() == 0
    assert lines(rdf.not_exists(rdf.match(triples, ("?n", rdf.RDF_TYPE, "?k")).select("n"), triples.select(F.col("o").alias("n"))), "n") == [("urn:vault:note/a%20b/x.md",)]
    assert rdf.merge(triples, triples).count() == 9


def test_paths_and_inference(spark):
    iris = lambda rows: spark.createDataFrame([(s, p, o, "iri", None, None) for s, p, o in rows], "s string, p string, o string, o_kind string, datatype string, lang string")
    t = iris([("a", "p", "b"), ("b", "p", "c"), ("c", "q", "d")])
    p, q = rdf.Path.of(t, "p"), rdf.Path.of(t, "q")
    pairs = lambda x: lines(x.pairs, "s", "o")
    assert pairs(p.plus()) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert pairs(p / q) == [("b", "d")] and pairs(~q) == [("d", "c")] and pairs(p | q) == [("a", "b"), ("b", "c"), ("c", "d")]
    assert pairs(q.maybe()) == sorted([("c", "d"), *((x, x) for x in "abcd")])
    assert set(pairs(p.star())) == set(pairs(p.plus())) | {(x, x) for x in "abcd"}
    schema = iris([("Cat", rdf.SUB_CLASS, "Pet"), ("Pet", rdf.SUB_CLASS, "Animal"), ("tom", rdf.RDF_TYPE, "Cat"), ("owns", rdf.DOMAIN, "Person"), ("owns", rdf.RANGE, "Pet"), ("ann", "owns", "rex"), ("owns", rdf.INVERSE, "ownedBy"), ("p", rdf.RDF_TYPE, rdf.TRANSITIVE), ("near", rdf.RDF_TYPE, rdf.SYMMETRIC), ("u", "near", "v"), ("a", "p", "b"), ("b", "p", "c")])
    made = set(lines(rdf.infer(schema), "s", "p", "o")) - set(lines(schema, "s", "p", "o"))
    assert made == {("Cat", rdf.SUB_CLASS, "Animal"), ("tom", rdf.RDF_TYPE, "Pet"), ("tom", rdf.RDF_TYPE, "Animal"), ("ann", rdf.RDF_TYPE, "Person"), ("rex", rdf.RDF_TYPE, "Pet"), ("rex", rdf.RDF_TYPE, "Animal"), ("rex", "ownedBy", "ann"), ("a", "p", "c"), ("v", "near", "u")}
    assert tuple(rdf.explosion(schema, rdf.infer(schema)).first()) == (12, 21, 21 / 12)


def test_inference_over_the_vault(spark):
    node = spark.createDataFrame([(x, "concept" if x == "a" else "", None, None) for x in "abcd"], "path string, type string, summary string, created string")
    edge = spark.createDataFrame([("a", "b", "", "builds_on"), ("b", "c", "", "builds_on"), ("c", "d", "", "builds_on"), ("a", "d", "", "links_to")], "src string, dst string, raw string, kind string")
    tag = spark.createDataFrame([("a", "S/P/q")], "path string, tag string")
    got = {r["p"] and re.split("[:#]", r["p"])[-1]: tuple(r)[1:] for r in rdf.inference_report(rdf.triples(Graph(node, edge, tag))).collect()}
    assert got.pop(None) == (15, 27, 27 / 15)
    assert got == {"type": (3, 7, 7 / 3), "subClassOf": (1, 1, 1.0), "domain": (1, 1, 1.0), "range": (1, 1, 1.0), "inverseOf": (2, 2, 1.0), "builds_on": (3, 6, 2.0), "links_to": (1, 1, 1.0), "linked_by": (0, 1, None), "tag": (1, 1, 1.0), "broader": (2, 3, 1.5), "narrower": (0, 3, None)}


@pytest.fixture
def files(tmp_path):
    for path, text in {"_Index.md": GOOD + "[[x]]", "_T/t.md": GOOD, ".hid/h.md": "h", "a/x.md": GOOD + "[[_Index]]\r\n[[gone]]", "a/.y.md": "y", "a/p.png": "p", "a/é.md": GOOD}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(text.encode())
    return str(tmp_path)


def test_source(spark, files):
    notes, targets = read_vault(spark, files)
    assert lines(notes, "path") == [(p,) for p in sorted(["_Index.md", "_T/t.md", "a/x.md", "a/é.md"])]
    assert lines(targets, "path") == [(p,) for p in sorted(["_Index.md", "_T/t.md", "a/x.md", "a/é.md", "a/p.png"])]
    assert notes.filter("path = 'a/x.md'").first()["text"].endswith("[[_Index]]\n[[gone]]")
    assert read_vault(spark, files, hidden="all")[1].count() == 7
    assert folder_names(files, "/nowhere") == ["_T", "a"]
    raw = spark.createDataFrame([(b"a\xff",)], "c binary")
    assert raw.select(decoded(F.col("c"), "skip")).first()[0] is None and raw.select(decoded(F.col("c"), "replace")).first()[0] == "a�"


def test_command_line(spark, files, monkeypatch, capsys):
    monkeypatch.setattr(cli, "get_session", lambda: spark)
    run = lambda *a: cli.main([*a, "--vault", files])
    assert run("q", "stats") == 2 and cli.main(["lint", "--vault", "/nowhere"]) == 2
    assert run("lint") == 1
    assert "a/x.md: link unresolved — gone" in capsys.readouterr().out
    assert run("build") == 0
    assert "node  4" in capsys.readouterr().out
    assert run("q", "near", "x") == 0 and run("q", "path", "x") == 0 and run("q", "near", "nope") == 2 and run("q", "type", "log") == 0 and run("q", "orphans") == 0 and run("q", "tag", "t") == 0
    assert run("q", "sql", "SELECT count(*) FROM node") == 0 and run("q", "path") == 2
    monkeypatch.setattr("sys.stdin", io.StringIO("text"))
    assert run("new", "a/new.md", "concept", "--summary", "s", "--builds-on", "x") == 0
    assert open(f"{files}/a/new.md").read().startswith('---\ntype: concept\nsummary: s\nbuilds_on:\n  - "[[x]]"\ncreated: ')
    monkeypatch.setattr("sys.stdin", io.StringIO(" "))
    assert run("new", "b/x.md", "nope") == 1
    said = capsys.readouterr().err
    assert all(w in said for w in ("empty body", "no such folder b", "name in use a/x.md", "type unknown nope"))
    assert run("template", "log") == 0 and run("template") == 0
    draft = f"{files}/draft.txt"
    with open(draft, "w") as f:
        f.write("---\ntype: x\nRating: 5\n---\n\nbody")
    assert run("ingest", draft, "a/in.md", "log", "--remove") == 0 and not os.path.exists(draft)
    assert "Rating: 5\ncreated" in open(f"{files}/a/in.md").read()
    assert cli.main(["doctor", files, "--vault", files]) == 0


def test_git_states_hook_and_restore(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "get_session", lambda: spark)
    root = str(tmp_path)
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    assert cli.main(["doctor", "--vault", root]) == 2 and cli.main(["install-hook", "--vault", root]) == 2
    git("init")
    for name, n in (("é.md", 20), ("b.md", 20), ("c.txt", 20)):
        (tmp_path / name).write_text("x\n" * n)
    git("add", "-A")
    git("commit", "-m", "one")
    assert cli.main(["doctor", "--vault", root]) == 0 and cli.main(["pre-commit", "--vault", root]) == 0
    (tmp_path / "b.md").write_text("x\n" * 5)
    os.remove(tmp_path / "é.md")
    capsys.readouterr()
    assert cli.main(["doctor", "--vault", root]) == 1
    assert capsys.readouterr().out.splitlines() == ["missing  é.md  ", "shrunk  b.md  20 -> 5"]
    git("add", "-A")
    assert cli.main(["pre-commit", "--vault", root]) == 1 and capsys.readouterr().out.splitlines() == ["deleted  é.md", "shrunk  b.md"]
    monkeypatch.setenv("NOTEGRAPH_ALLOW_LOSS", "1")
    assert cli.main(["pre-commit", "--vault", root]) == 0
    git("reset")
    assert cli.main(["doctor", "--restore", "--vault", root]) == 1 and (tmp_path / "é.md").exists()
    hook = tmp_path / ".git/hooks/pre-commit"
    hook.write_text("echo mine")
    assert cli.main(["install-hook", "--vault", root]) == 0 and cli.main(["install-hook", "--vault", root]) == 0
    assert os.access(hook, os.X_OK) and "notegraph.cli pre-commit" in hook.read_text() and (tmp_path / ".git/hooks/pre-commit.bak").read_text() == "echo mine"


def test_older_lint_and_store_from_the_command_line(spark, files, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "get_session", lambda: spark)
    run = lambda *a: cli.main([*a, "--vault", files])
    report = str(tmp_path / "report.json")
    with open(f"{files}/bare.md", "w") as f:
        f.write("no frontmatter")
    assert run("lint", "--older", "--json", report) == 1
    assert capsys.readouterr().out.splitlines()[0].startswith("links  ")
    with open(report) as f:
        told = json.load(f)
    assert list(told) == ["frontmatter", "links"] and {"src": "a/x.md", "target": "gone"} in told["links"] and {"file", "kind", "detail"} == set(told["frontmatter"][0])
    with open(f"{files}/.vault-lint.json", "w") as f:
        json.dump({"targets": ["gone"]}, f)
    assert older.load_ignores(files) == older.Ignores(targets=["gone"])
    run("lint", "--older")
    assert "exempt  1" in capsys.readouterr().out
    os.remove(f"{files}/.vault-lint.json")
    assert run("build", "--older") == 0
    meta = older.open_meta(spark, f"{files}/.notegraph")
    assert set(meta) == {"built", "excluded"} and meta["excluded"].startswith("800")
    assert run("lint", "--json", report) == 1
    assert "at most 80" in author.template("hub", "2024-01-01") and author.template("hub", "2024-01-01", bare=True) == "---\ntype: hub\nsummary: \ncreated: 2024-01-01\n---\n\n# Title\n\n\n"


def test_author(spark):
    with pytest.raises(ValueError):
        author.template("nope")
    new = author.render(spark, [author.Draft("d/a:b.md", "log", body="x", created="2026-01-01")])
    codes = lines(author.creation_findings(new, spark.createDataFrame([("d/a:b.md",), ("e/a:b.md",)], "path string")), "code", "detail")
    assert codes == [("bad file name", "a:b"), ("file exists", ""), ("name in use", "e/a:b.md")]
    notes = spark.createDataFrame([("Templates/x.md", "a"), ("y.md", "---\ntype: template\nsummary: s\n---\n"), ("z.md", "")], "path string, text string")
    assert lines(author.templates(notes), "path", "summary", "by_type") == [("Templates/x.md", "", False), ("y.md", "s", True)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a.md", "#tag")], "path string, text string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_findings(spark.readStream.schema("path string, text string").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("findings").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert lines(spark.table("findings"), "code") == [("body tag",), ("created missing",), ("type missing",)]
