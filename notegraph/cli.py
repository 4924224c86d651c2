"""Command line: python -m notegraph.cli COMMAND. Exit codes: 0 well, 1 findings, 2 can't run."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F

from notegraph.session import get_session

STORE = ".notegraph"
SHOWN = 20


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="notegraph")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, **more) -> argparse.ArgumentParser:
        c = sub.add_parser(name, **more)
        c.add_argument("--vault", default=".")
        return c

    c = command("lint")
    c.add_argument("--all", action="store_true", help="without exemptions")
    c.add_argument("--json", help="file for a report")
    c.add_argument("--older", action="store_true", help="as the older tool read notes")
    c.add_argument("--skills", action="append", default=[], help="folder whose directories may be linked to (older lint)")
    c = command("build")
    c.add_argument("--older", action="store_true", help="as the older tool read notes")
    q = command("q")
    q.add_argument("query", choices=["stats", "path", "near", "type", "tag", "orphans", "sql"])
    q.add_argument("argument", nargs="?")
    c = command("doctor")
    c.add_argument("head", nargs="?", help="folder of the earlier state; without it the last commit")
    c.add_argument("--restore", action="store_true", help="take missing notes back from git")
    command("pre-commit")
    command("install-hook")
    c = command("new")
    for a in ("path", "type"):
        c.add_argument(a)
    c.add_argument("--summary", default="")
    c.add_argument("--builds-on", action="append", default=[])
    c.add_argument("--force", action="store_true")
    c = command("ingest")
    for a in ("source", "path", "type"):
        c.add_argument(a)
    c.add_argument("--summary", default="")
    c.add_argument("--remove", action="store_true")
    c = command("template")
    c.add_argument("type", nargs="?")
    c.add_argument("--bare", action="store_true", help="without hints")
    return p


def _show(df) -> None:
    for row in df.toLocalIterator():
        print("  ".join("" if v is None else str(v) for v in row))


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if not os.path.isdir(args.vault):
        print(f"no such directory: {args.vault}", file=sys.stderr)
        return 2
    from notegraph.plans import author, build, catalog, lint, older, snapshot
    from notegraph.sources import git
    from notegraph.sources.vault import folder_names, read_vault

    if args.command == "install-hook":
        made = git.install_hook(args.vault)
        print(f"no git repository: {args.vault}" if made is None else f"installed {made[0]}" + (f", the one before is {made[1]}" if made[1] else ""), file=sys.stderr)
        return 2 if made is None else 0
    if args.command == "pre-commit" and os.environ.get(git.OVERRIDE):
        return 0
    spark = get_session()
    if args.command == "pre-commit":
        found = snapshot.gate(*git.states(spark, args.vault, staged=True)).orderBy("check", "path")
        if found.isEmpty():
            return 0
        _show(found)
        print(f"this commit loses notes; {git.OVERRIDE}=1 lets it pass", file=sys.stderr)
        return 1
    if args.command == "lint":
        notes, targets = read_vault(spark, args.vault)
        if args.older:
            ig, skills = older.load_ignores(args.vault), folder_names(*args.skills)
            found = older.lint(notes, targets, ig.sources, ig.targets, ig.files, skills, args.all).orderBy("path", "seq")
            _show(older.link_totals(notes, targets, ig, skills, args.all))
        else:
            found = lint.lint(notes, targets, lint.Rules() if args.all else lint.load_rules(args.vault)).orderBy("path", "seq")
        if args.json:
            lint.write_report(found, args.json)
        n = 0
        for r in found.toLocalIterator():
            print(f"{r['path']}: {r['code']} — {r['detail']}" if r["detail"] else f"{r['path']}: {r['code']}")
            n += 1
        print(f"{n} findings", file=sys.stderr)
        return 1 if n else 0
    if args.command == "build":
        notes, targets = read_vault(spark, args.vault)
        if args.older:
            older.write_store(*older.build(notes), os.path.join(args.vault, STORE))
        else:
            build.build(notes, targets, "bytes").write(os.path.join(args.vault, STORE))
        _show(catalog.stats(build.open_graph(spark, os.path.join(args.vault, STORE))).orderBy("section", F.desc("n")))
        return 0
    if args.command == "doctor":
        sides = []
        if args.head is None and not git.is_repository(args.vault):
            print(f"no git repository: {args.vault}", file=sys.stderr)
            return 2
        if args.head is None:
            sides = git.states(spark, args.vault)
            if args.restore:
                for path in git.restore(args.vault, [r["path"] for r in snapshot.missing(*sides).toLocalIterator()]):
                    print(f"not in the index either: {path}", file=sys.stderr)
                sides = git.states(spark, args.vault)
        else:
            for root in (args.head, args.vault):
                notes, _ = read_vault(spark, root, errors="replace")
                sides.append(notes.select("path", snapshot.line_count(F.col("text")).alias("lines")))
        _, files = read_vault(spark, args.vault, hidden="git", errors="replace")
        found = snapshot.doctor(*sides, files).orderBy("check", "path")
        _show(found)
        return 0 if found.isEmpty() else 1
    if args.command in ("new", "ingest"):
        draft = author.Draft(args.path, args.type, args.summary, getattr(args, "builds_on", []), body=sys.stdin.read() if args.command == "new" else "")
        against = author.create(spark, args.vault, draft, args.force) if args.command == "new" else author.ingest(spark, args.vault, args.source, draft, args.remove)
        for code, detail in against:
            print(f"{code} {detail}".strip(), file=sys.stderr)
        return 1 if against else 0
    if args.command == "template":
        if args.type:
            print(author.template(args.type, bare=args.bare))
        else:
            _show(author.templates(read_vault(spark, args.vault, errors="replace")[0]).orderBy("path"))
        return 0
    store = os.path.join(args.vault, STORE)
    if not os.path.isdir(store):
        print("no graph here; build it first", file=sys.stderr)
        return 2
    g = build.open_graph(spark, store)
    if args.query == "stats":
        _show(catalog.stats(g).orderBy("section", F.desc("n")))
    elif args.query == "orphans":
        _show(catalog.orphans(g, args.argument))
    elif args.argument is None:
        print("an argument is missing", file=sys.stderr)
        return 2
    elif args.query in ("type", "tag"):
        _show((catalog.by_type if args.query == "type" else catalog.by_tag)(g, args.argument))
    elif args.query == "sql":
        _show(catalog.sql(g, args.argument))
    else:
        start = catalog.find(g, args.argument).first()
        if start is None:
            print(f"no such note: {args.argument}", file=sys.stderr)
            return 2
        if args.query == "path":
            _show(catalog.learning_path(g, start["path"]))
        else:
            near = catalog.near(g, start["path"])
            for rel in ("links_to", "linked_by", "shares_tag"):
                part = near.filter(F.col("rel") == rel)
                _show(part.limit(SHOWN) if rel == "shares_tag" else part)
    return 0


if __name__ == "__main__":
    sys.exit(main())
