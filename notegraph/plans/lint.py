"""All violations of the note schema as rows."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions import text as T
from notegraph.operators.resolve import resolve
from notegraph.plans.build import PARSED, RESOLVED, parse, vault_notes, vault_targets
from notegraph.session import cut

#: The closed vocabulary of types and the limits of the schema.
TYPES = ["concept", "procedure", "principle", "decision", "tradeoff", "case", "source-note", "reflection", "project-doc", "reference", "log", "hub", "template"]
NEEDS_SUMMARY = ["concept", "procedure", "reference", "case"]
SUMMARY_MAX = 80
BUILDS_ON_MAX = 3
CONFIG_NAME = ".vault-lint.json"


@dataclass(frozen=True)
class Rules:
    """What is exempt; all lists default to none, unknown keys of a file are ignored."""

    skip_unresolved_from: list[str] = field(default_factory=list)
    skip_unresolved_to: list[str] = field(default_factory=list)
    skip_frontmatter_in: list[str] = field(default_factory=list)
    skip_files: list[str] = field(default_factory=list)


def load_rules(root: str) -> Rules:
    """The rules beside the notes; a missing file or key gives the default."""
    path = Path(root) / CONFIG_NAME
    given = json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}
    return Rules(**{f.name: given[f.name] for f in fields(Rules) if f.name in given})


def _finding(code: str, detail, when) -> F.Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), detail.alias("detail")))


def schema_findings(parsed: DataFrame) -> F.Column:
    """array of (code, detail) of the rules on a note's own fields, in their order."""
    t, s, c, b = F.col("type"), F.col("summary"), F.col("created"), F.col("builds_on")
    empty = lambda x: x.isNull() | (x == "")
    blank = F.lit("")
    rules = [
        _finding("type missing", blank, empty(t)),
        _finding("type unknown", t, ~empty(t) & ~t.isin(TYPES)),
        _finding("summary missing", blank, empty(s) & F.coalesce(t.isin(NEEDS_SUMMARY), F.lit(False))),
        _finding("summary too long", F.concat(F.length(s).cast("string"), F.lit("자")), F.length(s) > SUMMARY_MAX),
        _finding("builds_on too many", F.concat(F.size(b).cast("string"), F.lit("개")), F.size(b) > BUILDS_ON_MAX),
        _finding("created missing", blank, empty(c)),
        _finding("created invalid", c, ~empty(c) & ~T.is_iso_date(c)),
    ]
    return F.array_compact(F.array(*rules))


def lint(notes: DataFrame, targets: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """path, code, detail, seq: every violation, numbered within its note.

    First the schema, tags in the body and prerequisites that resolve nowhere, unless the note is
    exempt by skip_files or skip_frontmatter_in; then links in the body that resolve nowhere, unless
    their source or target is exempt. notes: path, text; targets: path.
    """
    path = F.col("path")
    parsed = cut(parse(notes.filter("path IS NOT NULL AND text IS NOT NULL")).withColumn("body_tags", T.body_tags(F.col("body"))).drop("text", "fm", "body"))
    exempt = path.isin(rules.skip_files) if rules.skip_files else F.lit(False)
    checked = parsed.filter(~(exempt | T.under(path, rules.skip_frontmatter_in)))
    tags = F.transform("body_tags", lambda x: F.struct(F.lit("body tag").alias("code"), x.alias("detail")))
    own = checked.select("path", F.posexplode(F.concat(schema_findings(parsed), tags)).alias("pos", "f")).select("path", F.lit(0).alias("part"), "pos", "f.code", "f.detail")

    def unresolved(df: DataFrame, column: str, part: int, code: str) -> DataFrame:
        asked = df.select(path.alias("src"), F.posexplode(column).alias("pos", "target"), F.lit(part).alias("part"), F.lit(code).alias("code"))
        return asked

    wanted = unresolved(checked.withColumn("builds_on", F.transform("builds_on", T.link_target)), "builds_on", 1, "builds_on unresolved")
    sources = parsed.filter(~(exempt | T.under(path, rules.skip_unresolved_from)))
    links = unresolved(sources, "links", 2, "link unresolved")
    if rules.skip_unresolved_to:
        links = links.filter(~F.col("target").isin(rules.skip_unresolved_to))
    asked = cut(wanted.unionByName(links))
    dead = resolve(asked, targets, asked.count()).filter("landed IS NULL")
    every = own.unionByName(dead.select(F.col("src").alias("path"), "part", "pos", "code", F.col("target").alias("detail")))
    listed = every.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "pos", "code", "detail"))).alias("l"))
    return listed.select("path", F.posexplode("l").alias("seq", "x")).select("path", "x.code", "x.detail", "seq")


def summary(findings: DataFrame) -> DataFrame:
    """code, n: how often each kind occurs, digits in its name put as N."""
    return findings.groupBy(F.regexp_replace("code", r"\d+", "N").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def broken_targets(findings: DataFrame, top: int = 30) -> DataFrame:
    """target, n: the unresolved targets of body links that occur most (a report; ties by text)."""
    return findings.filter("code = 'link unresolved'").groupBy(F.col("detail").alias("target")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "target").limit(top)


def report_json(findings: DataFrame) -> DataFrame:
    """One JSON object for each finding, to be written as text."""
    return findings.select(F.to_json(F.struct(F.col("path").alias("file"), F.col("code").alias("kind"), "detail")).alias("value"))


def write_report(findings: DataFrame, path: str) -> None:
    """One JSON file with two sections: findings on frontmatter (file, kind, detail) and on links (src, target)."""
    link = F.col("code").isin("link unresolved", "link")
    own = findings.filter(~link).orderBy("path", "seq").select(F.to_json(F.struct(F.col("path").alias("file"), F.col("code").alias("kind"), "detail")))
    links = findings.filter(link).orderBy("path", "seq").select(F.to_json(F.struct(F.col("path").alias("src"), F.col("detail").alias("target"))))
    with open(path, "w", encoding="utf-8") as f:
        for name, rows, end in (("frontmatter", own, ",\n"), ("links", links, "\n")):
            f.write(("{\n" if name == "frontmatter" else "") + f' "{name}": [')
            for n, r in enumerate(rows.toLocalIterator()):
                f.write(("," if n else "") + "\n  " + r[0])
            f.write("]" + end)
        f.write("}\n")


def exit_code(findings: DataFrame) -> int:
    return 0 if findings.isEmpty() else 1


def lint_findings(spark: SparkSession, d: str) -> DataFrame:
    return lint(vault_notes(spark, d), vault_targets(spark, d))


def lint_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = Rules(skip_unresolved_from=["300 Reading"], skip_unresolved_to=["Todo"], skip_frontmatter_in=["950 Attic"])
    return lint(vault_notes(spark, d), vault_targets(spark, d), rules)


def lint_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary(lint_findings(spark, d))


def lint_targets(spark: SparkSession, d: str) -> DataFrame:
    return broken_targets(lint_findings(spark, d))


QUERIES = {f.__name__: f for f in (lint_findings, lint_rules, lint_summary, lint_targets)}

_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_ISO = """(regexp_matches(created, '^\\d{4}-\\d{2}-\\d{2}$') AND try_cast(created AS DATE) IS NOT NULL AND substr(created, 1, 4) <> '0000'
 OR regexp_matches(created, '^\\d{8}$') AND try_strptime(created, '%Y%m%d') IS NOT NULL AND substr(created, 1, 4) <> '0000')"""


def _sql(own: str, links: str) -> str:
    return f"""
WITH {PARSED}, {RESOLVED},
checked AS (SELECT * FROM parsed WHERE {own}),
found AS (
  SELECT path, 0 AS part, 0 AS pos, 'type missing' AS code, '' AS detail FROM checked WHERE coalesce(type, '') = ''
  UNION ALL SELECT path, 0, 1, 'type unknown', type FROM checked WHERE type <> '' AND type NOT IN ({_IN(TYPES)})
  UNION ALL SELECT path, 0, 2, 'summary missing', '' FROM checked WHERE coalesce(summary, '') = '' AND type IN ({_IN(NEEDS_SUMMARY)})
  UNION ALL SELECT path, 0, 3, 'summary too long', length(summary) || '자' FROM checked WHERE length(summary) > {SUMMARY_MAX}
  UNION ALL SELECT path, 0, 4, 'builds_on too many', len(builds_on) || '개' FROM checked WHERE len(builds_on) > {BUILDS_ON_MAX}
  UNION ALL SELECT path, 0, 5, 'created missing', '' FROM checked WHERE coalesce(created, '') = ''
  UNION ALL SELECT path, 0, 6, 'created invalid', created FROM checked WHERE created <> '' AND NOT {_ISO}
  UNION ALL SELECT path, 0, 7 + generate_subscripts(body_tags, 1), 'body tag', unnest(body_tags) FROM checked
  UNION ALL SELECT b.path, 1, b.pos, 'builds_on unresolved', b.t FROM (
    SELECT path, generate_subscripts(builds_on, 1) AS pos, unnest(list_transform(builds_on, lambda x: regexp_replace(regexp_extract(x, '^((?s:.*?))(?:\\\\\\||\\||#|\\^|$)', 1), '^\\s+|\\s+$', '', 'g'))) AS t FROM checked) b
    WHERE nfc_normalize(b.t) NOT IN (SELECT k FROM keys)
  UNION ALL SELECT l.path, 2, l.pos, 'link unresolved', l.t FROM (SELECT path, generate_subscripts(links, 1) AS pos, unnest(links) AS t FROM parsed WHERE {links}) l
    WHERE nfc_normalize(l.t) NOT IN (SELECT k FROM keys) AND {{to}})
SELECT path, code, detail, CAST(row_number() OVER (PARTITION BY path ORDER BY part, pos) - 1 AS INTEGER) AS seq FROM found"""


_ALL = _sql("true", "true").replace("{to}", "true")
SQL = {
    "lint_findings": _ALL,
    "lint_rules": _sql("NOT starts_with(path, '950 Attic/') AND path <> '950 Attic'", "NOT starts_with(path, '300 Reading/') AND path <> '300 Reading'").replace("{to}", "l.t <> 'Todo'"),
    "lint_summary": f"SELECT code, count(*) AS n FROM ({_ALL}) GROUP BY code",
    "lint_targets": f"SELECT detail AS target, count(*) AS n FROM ({_ALL}) WHERE code = 'link unresolved' GROUP BY detail ORDER BY n DESC, target LIMIT 30",
}
