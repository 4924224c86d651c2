"""New notes: rendered, checked by the same rules as lint, and written only when none is broken."""

from __future__ import annotations

import datetime
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions import legacy
from notegraph.operators.resolve import link_keys
from notegraph.plans.lint import TYPES, lint
from notegraph.session import cut
from notegraph.sources.tables import table
from notegraph.sources.vault import read_vault


@dataclass(frozen=True)
class Draft:
    path: str
    type: str
    summary: str = ""
    builds_on: list[str] = field(default_factory=list)
    created: str = ""
    extra: list[str] = field(default_factory=list)
    body: str = ""


def frontmatter_column(type_, summary, extra, builds_on, created) -> F.Column:
    """Frontmatter in the order of the schema; items of builds_on get their brackets."""
    item = lambda b: F.concat(F.lit('  - "'), F.when(F.trim(b).startswith("[[") & F.trim(b).endswith("]]"), F.trim(b)).otherwise(F.concat(F.lit("[["), F.trim(b), F.lit("]]"))), F.lit('"'))
    lines = F.concat(
        F.array(F.concat(F.lit("type: "), type_)),
        F.when(F.coalesce(summary, F.lit("")) != "", F.array(F.concat(F.lit("summary: "), summary))).otherwise(F.array().cast("array<string>")),
        F.transform(extra, lambda b: F.rtrim(b)),
        F.when(F.size(builds_on) > 0, F.concat(F.array(F.lit("builds_on:")), F.transform(builds_on, item))).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(F.lit("created: "), created)),
    )
    return F.array_join(lines, "\n")


def render(spark: SparkSession, drafts: list[Draft]) -> DataFrame:
    """path, body, text of some drafts."""
    today = datetime.date.today().isoformat()
    rows = [(d.path, d.type, d.summary, d.builds_on, d.created or today, d.extra, d.body) for d in drafts]
    df = spark.createDataFrame(rows, "path string, type string, summary string, builds_on array<string>, created string, extra array<string>, body string")
    fm = frontmatter_column(*(F.col(c) for c in ("type", "summary", "extra", "builds_on", "created")))
    return df.select("path", "body", F.concat(F.lit("---\n"), fm, F.lit("\n---\n\n"), "body").alias("text"))


def creation_findings(new: DataFrame, targets: DataFrame, folders: DataFrame | None = None, force: bool = False) -> DataFrame:
    """path, code, detail: all that speaks against writing `new` (path, body, text) beside `targets` (path)."""
    title = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md\z", "")
    found = lambda df, code, detail: df.select("path", F.lit(code).alias("code"), detail.alias("detail"))
    out = lint(new.select("path", "text"), targets.select("path").union(new.select("path"))).select("path", "code", "detail")
    out = out.unionByName(found(new.filter(legacy.bad_name(title)), "bad file name", title))
    out = out.unionByName(found(new.filter(F.trim(F.coalesce("body", F.lit(""))) == ""), "empty body", F.lit("")))
    if folders is not None:
        parent = new.withColumn("folder", F.regexp_extract("path", r"\A(?s:(.*))/[^/]*\z", 1)).filter("folder <> ''")
        out = out.unionByName(found(parent.join(folders.select("folder"), "folder", "left_anti"), "no such folder", F.col("folder")))
    if not force:
        out = out.unionByName(found(new.join(targets.select("path").distinct(), "path", "left_semi"), "file exists", F.lit("")))
        keys = link_keys(targets).withColumnRenamed("path", "other")
        used = new.select("path", title.alias("key")).join(keys, "key").filter("other <> path").groupBy("path").agg(F.min("other").alias("other"))
        out = out.unionByName(found(used, "name in use", F.col("other")))
    return out


def create(spark: SparkSession, root: str, draft: Draft, force: bool = False) -> list[tuple[str, str]]:
    """Write the note, or return why not."""
    _, targets = read_vault(spark, root)
    new = render(spark, [draft])
    folders = spark.createDataFrame([(os.path.relpath(f, root).replace(os.sep, "/"),) for f, _, _ in os.walk(root)], "folder string")
    against = [(r["code"], r["detail"]) for r in creation_findings(new, targets, folders, force).orderBy("code", "detail").collect()]  # of one note
    if not against:
        with open(os.path.join(root, draft.path), "w", encoding="utf-8") as f:
            f.write(new.first()["text"])
    return against


def ingest(spark: SparkSession, root: str, source: str, draft: Draft, remove: bool = False, force: bool = False) -> list[tuple[str, str]]:
    """Like create, from a file: its body, and the fields of its frontmatter that a draft doesn't set."""
    from notegraph.functions import text as T

    with open(source, encoding="utf-8") as f:
        one = spark.createDataFrame([(f.read(),)], "text string")
    parts = one.select(T.body(F.col("text")).alias("body"), legacy.fm_blocks(T.frontmatter(F.col("text"))).alias("blocks")).first()
    own = {"type", "summary", "builds_on", "created"}
    extra = [b["block"] for b in parts["blocks"] if b["key"] not in own]
    merged = Draft(draft.path, draft.type, draft.summary, draft.builds_on, draft.created, [*extra, *draft.extra], parts["body"].lstrip("\n"))
    against = create(spark, root, merged, force)
    if not against and remove:
        os.remove(source)
    return against


#: A question that a note of each type answers, as a hint in its skeleton.
HINTS = {
    "concept": "What does the term mean, and what is an example of it?", "procedure": "Which steps, in which order, and how does one check each?",
    "principle": "Which rule holds here, and on what grounds?", "decision": "Which option was taken, by whom and when?",
    "tradeoff": "Which options are there, and what does each cost?", "case": "What happened, in order of time?",
    "source-note": "Who wrote this, where, and what is quoted?", "reflection": "Which thought, and how did it come up?",
    "project-doc": "What is the goal, and what is the state?", "reference": "Which values belong together in one table?", "log": "What was seen at which time?",
    "hub": "Which notes belong to this topic?", "template": "Which fields does a copy of this have to fill?",
}


def template(type_: str, today: str | None = None, bare: bool = False) -> str:
    """The skeleton of a note; bare: without hints."""
    if type_ not in TYPES:
        raise ValueError(f"no such type: {type_}")
    summary = "" if bare else "in at most 80 characters"
    return f"---\ntype: {type_}\nsummary: {summary}\ncreated: {today or datetime.date.today().isoformat()}\n---\n\n# Title\n\n{'' if bare else HINTS[type_]}\n"


def templates(notes: DataFrame) -> DataFrame:
    """path, summary, by_type of the templates among `notes` (path, text), by type or by place."""
    from notegraph.functions import text as T

    fm = T.frontmatter(F.col("text"))
    by_type = F.coalesce(fm.rlike(r"(?md)^type:\s*template\s*$"), F.lit(False))
    return notes.filter(legacy.is_template(F.col("path"), fm)).select("path", F.coalesce(T.fm_get(fm, "summary"), F.lit("")).alias("summary"), by_type.alias("by_type"))


def template_list(spark: SparkSession, d: str) -> DataFrame:
    from notegraph.plans.build import vault_notes

    return templates(vault_notes(spark, d))


#: Example of a routing table: which types are usual where. The real one is configuration.
ZONES = {"300 Reading": ["source-note", "hub", "reference"], "000 Landing": ["log", "reflection"]}


def routing(spark: SparkSession, d: str) -> DataFrame:
    """path, type, place of notes whose type is not usual in their zone."""
    from notegraph.plans.catalog import latest

    g = latest(spark, d)
    place = legacy.routing_warning(F.col("path"), F.col("type"), {}, ZONES)
    return g.node.select("path", "type", place.alias("place")).filter("place IS NOT NULL")


def rendered(spark: SparkSession, d: str) -> DataFrame:
    """Frontmatter rendered anew for every note of the tables."""
    from notegraph.plans.catalog import latest

    g = latest(spark, d)
    up = g.edge.filter("kind = 'builds_on'").groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_set("raw")).alias("ups"))
    none = F.array().cast("array<string>")
    fm = frontmatter_column(F.coalesce("type", F.lit("")), F.col("summary"), none, F.coalesce("ups", none), F.coalesce("created", F.lit("")))
    return g.node.join(up, "path", "left").select("path", fm.alias("fm"))


def create_gate(spark: SparkSession, d: str) -> DataFrame:
    """What speaks against writing a note for each link that landed nowhere, in the folder of its source.

    The link's text is the title, its kind the type; links of kind builds_on come with an empty body.
    Folders are those of notes named like their zone's first, so that some are missing.
    """
    edge, node = table(spark, d, "edge"), table(spark, d, "node")
    dir_ = lambda p: F.regexp_extract(p, r"\A((?s:.*))/[^/]*\z", 1)
    wanted = edge.filter("dst IS NULL AND src IS NOT NULL").select(dir_("src").alias("dir"), F.regexp_replace("raw", "/", " ").alias("title"), "kind").filter("title <> ''")
    wanted = wanted.groupBy("dir", "title").agg(F.min("kind").alias("kind"))
    path = F.concat(F.when(F.col("dir") != "", F.concat("dir", F.lit("/"))).otherwise(F.lit("")), "title", F.lit(".md"))
    fm = frontmatter_column(F.col("kind"), F.col("title"), F.array().cast("array<string>"), F.array().cast("array<string>"), F.lit("2024-02-30"))
    body = F.when(F.col("kind") == "builds_on", F.lit("")).otherwise(F.lit("Written for a link."))
    new = cut(wanted.select(path.alias("path"), body.alias("body"), F.concat(F.lit("---\n"), fm, F.lit("\n---\n\n"), body).alias("text")))
    targets = node.select("path").filter("path IS NOT NULL").distinct()
    folders = targets.select(dir_("path").alias("folder")).filter("folder LIKE '%a%'").distinct()
    return creation_findings(new, targets, folders)


QUERIES = {f.__name__: f for f in (template_list, routing, rendered, create_gate)}

from notegraph.plans.build import _DIR, PARSED  # noqa: E402
from notegraph.plans.catalog import _G  # noqa: E402

SQL = {
    "template_list": f"WITH {PARSED} SELECT path, coalesce(summary, '') AS summary, coalesce(regexp_matches(fm, '(?m)^type:\\s*template\\s*$'), false) AS by_type FROM parsed WHERE regexp_matches(fm, '(?m)^type:\\s*template\\s*$') OR regexp_matches(path, '(^|/)(Templates|_Template)/|(^|/)_template\\.md$')",
    "routing": f"WITH {_G} SELECT path, type, zone AS place FROM gn WHERE (zone = '300 Reading' AND type NOT IN ('source-note', 'hub', 'reference')) OR (zone = '000 Landing' AND type NOT IN ('log', 'reflection'))",
    "create_gate": f"""
WITH wanted AS (SELECT {_DIR.replace('path', 'src')} AS dir, replace(raw, '/', ' ') AS title, min(kind) AS kind FROM edge WHERE dst IS NULL AND src IS NOT NULL AND raw <> '' GROUP BY ALL),
new AS (SELECT *, CASE WHEN dir <> '' THEN dir || '/' ELSE '' END || title || '.md' AS path FROM wanted),
t AS (SELECT DISTINCT path FROM node WHERE path IS NOT NULL),
folders AS (SELECT DISTINCT {_DIR} AS folder FROM t),
parts AS (SELECT path, string_split(regexp_replace(path, '\\.md$', ''), '/') AS p FROM t WHERE path LIKE '%.md'),
keys AS (SELECT string_split(path, '/')[-1] AS k, path FROM t UNION SELECT array_to_string(p[i:], '/'), path FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM parts))
SELECT path, 'type unknown' AS code, kind AS detail FROM new
UNION ALL SELECT path, 'summary too long', length(trim(title)) || '자' FROM new WHERE length(trim(title)) > 80
UNION ALL SELECT path, 'created invalid', '2024-02-30' FROM new
UNION ALL SELECT path, 'bad file name', title FROM new WHERE regexp_matches(title, '[`\\[\\]|#^\\\\/:*?"<>]')
UNION ALL SELECT path, 'empty body', '' FROM new WHERE kind = 'builds_on'
UNION ALL SELECT path, 'no such folder', dir FROM new WHERE dir <> '' AND dir NOT IN (SELECT folder FROM folders WHERE folder LIKE '%a%')
UNION ALL SELECT path, 'file exists', '' FROM new WHERE path IN (SELECT path FROM t)
UNION ALL SELECT n.path, 'name in use', min(k.path) FROM new n JOIN keys k ON k.k = n.title WHERE k.path <> n.path GROUP BY n.path""",
    "rendered": f"""WITH {_G}, ups AS (SELECT src AS path, string_agg(raw, chr(10) ORDER BY raw) AS u FROM (SELECT DISTINCT src, '  - "' || CASE WHEN starts_with(trim(raw), '[[') AND ends_with(trim(raw), ']]') THEN trim(raw) ELSE '[[' || trim(raw) || ']]' END || '"' AS raw FROM ge WHERE kind = 'builds_on') GROUP BY src)
SELECT path, 'type: ' || coalesce(type, '') || CASE WHEN summary <> '' THEN chr(10) || 'summary: ' || summary ELSE '' END || coalesce(chr(10) || 'builds_on:' || chr(10) || u, '') || chr(10) || 'created: ' || coalesce(created, '') AS fm FROM gn LEFT JOIN ups USING (path)""",
}
