"""Lint and build as the older tool read notes, for comparison with the present ones."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions import legacy as L
from notegraph.functions import text as T
from notegraph.operators.skew import heavy_keys, skew_join
from notegraph.plans.build import _DIR, _TRIM, PARSED, Graph, vault_notes, vault_targets
from notegraph.plans.lint import _ISO, BUILDS_ON_MAX, SUMMARY_MAX, TYPES
from notegraph.session import cut
from notegraph.sources.tables import table

#: What the older tool exempts, by bare prefix.
EXCLUDED = ["800 TRPG", "900 Archive", ".claude", ".trash", ".obsidian"]
EXCLUDED_FILES = ["CLAUDE.md"]
IGNORED_SOURCES = ["300 Runtime/301 Day Notes", "100 Private Log/102 Monthly Diary", "800 TRPG", "900 Archive", ".claude", ".trash"]
IGNORED_TARGETS = ["...", "참조", "파일명", "제목", "경로", "예시"]


CONFIG_NAME = ".vault-lint.json"


@dataclass(frozen=True)
class Ignores:
    """What the older lint exempts; keys missing from the file beside the notes keep these."""

    sources: list[str] = field(default_factory=lambda: list(IGNORED_SOURCES))
    targets: list[str] = field(default_factory=lambda: list(IGNORED_TARGETS))
    files: list[str] = field(default_factory=list)


def load_ignores(root: str) -> Ignores:
    path = Path(root) / CONFIG_NAME
    given = json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}
    return Ignores(**{f.name: given[f.name] for f in fields(Ignores) if f.name in given})


def prefixed(path: F.Column, prefixes: list[str]) -> F.Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def known_keys(targets: DataFrame) -> DataFrame:
    """key: all that resolves: every end of a path after a slash, with .md and without."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    both = F.concat(ends, F.transform(F.filter(ends, lambda x: x.endswith(".md")), lambda x: F.regexp_replace(x, r"\.md\z", "")))
    return targets.select(F.explode(both).alias("key")).distinct()


def _parsed(notes: DataFrame) -> DataFrame:
    text = T.universal_newlines(F.col("text"))
    df = notes.withColumn("text", text).withColumn("fm", T.frontmatter(F.col("text"))).withColumn("body", T.body(F.col("text")))
    return df.withColumn("raw_links", L.raw_links(F.col("body")))


def _get(fm: F.Column, pattern: str) -> F.Column:
    return F.when(fm.rlike(pattern), F.regexp_extract(fm, pattern, 1))


def lint(notes: DataFrame, targets: DataFrame, sources: list[str] = IGNORED_SOURCES, ignored: list[str] = IGNORED_TARGETS, files: list[str] = (), skills: list[str] = (), show_all: bool = False) -> DataFrame:
    """path, code, detail, seq. A note without frontmatter has that one finding and its broken links."""
    fm, path = F.col("fm"), F.col("path")
    p = cut(_parsed(notes).withColumn("junk", L.junk_tags(L.strip_code(F.col("body")))).withColumn("ups", L.fm_list(fm, "builds_on")).drop("text", "body"))
    skip = F.lit(False) if show_all else prefixed(path, list(sources)) | path.isin(list(files))
    type_, created = _get(fm, r"(?mdU)^type:\s*(\S+)\s*$"), _get(fm, r"(?mdU)^created:\s*(\S+)\s*$")
    summary = F.btrim(T.strip(_get(fm, r"(?md)^summary:[ \t]*(.+)$")), F.lit("\"'"))
    blank = F.lit("")
    rule = lambda when, code, detail: F.when(when, F.struct(code.alias("code"), detail.alias("detail")))
    rules = F.array_compact(F.array(
        rule(fm.isNull(), F.lit("frontmatter 없음"), blank),
        rule(fm.isNotNull() & type_.isNull(), F.lit("type 없음"), blank),
        rule(~type_.isin(TYPES), F.lit("type가 13값 밖"), type_),
        rule(F.length(summary) > SUMMARY_MAX, F.concat(F.lit("summary "), F.length(summary).cast("string"), F.lit(f"자 (상한 {SUMMARY_MAX})")), F.concat(F.substring(summary, 1, 40), F.lit("…"))),
        rule(fm.isNotNull() & created.isNull(), F.lit("created 없음"), blank),
        rule(created.isNotNull() & ~T.is_iso_date(created), F.lit("created 형식 오류"), created),
        rule(F.size("ups") > BUILDS_ON_MAX, F.concat(F.lit("builds_on "), F.size("ups").cast("string"), F.lit(f"개 (상한 {BUILDS_ON_MAX})")), blank),
    ))
    tags = F.when(fm.isNotNull(), F.transform("junk", lambda x: F.struct(F.lit("의도치 않은 태그").alias("code"), x.alias("detail")))).otherwise(F.array().cast("array<struct<code:string,detail:string>>"))
    checked = p.filter(~skip)
    own = checked.select("path", F.posexplode(rules).alias("pos", "f")).select("path", F.lit(0).alias("part"), "pos", "f.code", "f.detail")
    junk = checked.select("path", F.posexplode(tags).alias("pos", "f")).select("path", F.lit(2).alias("part"), "pos", "f.code", "f.detail")
    ups = checked.select("path", F.lit(1).alias("part"), F.posexplode("ups").alias("pos", "detail"), F.lit("builds_on 미해결").alias("code"))
    links = p.select("path", F.lit(3).alias("part"), F.posexplode("raw_links").alias("pos", "raw"), F.lit("link").alias("code"), skip.alias("skip"))
    links = links.withColumn("detail", L.link_target(F.col("raw"))).filter("detail <> ''")
    if not show_all:
        exempt = F.col("skip") | F.col("detail").isin(list(ignored)) | L.is_placeholder(F.col("detail"))
        if skills:
            exempt = exempt | L.is_skill_ref(F.col("detail"), list(skills))
        links = links.filter(~exempt)
    asked = cut(ups.select("path", "part", "pos", "code", "detail", L.link_target(F.col("detail")).alias("key")).unionByName(links.select("path", "part", "pos", "code", "detail", F.col("detail").alias("key"))))
    known = known_keys(targets).withColumn("known", F.lit(True))
    dead = skew_join(asked, known, "key", "left", heavy_keys(asked, "key", rows=asked.count())).filter("known IS NULL").select("path", "part", "pos", "code", "detail")
    every = own.unionByName(junk).unionByName(dead)
    listed = every.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "pos", "code", "detail"))).alias("l"))
    return listed.select("path", F.posexplode("l").alias("seq", "x")).select("path", "x.code", "x.detail", "seq")


def link_totals(notes: DataFrame, targets: DataFrame, ignores: Ignores = Ignores(), skills: list[str] = (), show_all: bool = False) -> DataFrame:
    """measure, n: links in bodies, those that resolve nowhere, and those of them that are exempt."""
    p = _parsed(notes).select("path", F.explode("raw_links").alias("raw")).select("path", L.link_target(F.col("raw")).alias("key")).filter("key <> ''")
    asked = cut(p.groupBy("path", "key").agg(F.count(F.lit(1)).alias("times")))
    known = known_keys(targets).withColumn("known", F.lit(True))
    found = skew_join(asked, known, "key", "left", heavy_keys(asked, "key", rows=asked.count()))
    path, key = F.col("path"), F.col("key")
    exempt = F.lit(False)
    if not show_all:
        exempt = prefixed(path, ignores.sources) | path.isin(ignores.files) | key.isin(ignores.targets) | L.is_placeholder(key)
        if skills:
            exempt = exempt | L.is_skill_ref(key, list(skills))
    dead = F.col("known").isNull()
    sums = {"links": F.lit(True), "broken": dead & ~exempt, "exempt": dead & exempt}
    one = found.agg(*[F.coalesce(F.sum(F.when(v, F.col("times"))), F.lit(0)).alias(k) for k, v in sums.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("n")) for k in sums])).alias("r")).select("r.*")


def write_store(graph: Graph, meta: DataFrame, folder: str) -> None:
    """The graph and the row about its making, anew."""
    graph.write(folder)
    meta.write.mode("overwrite").parquet(f"{folder}/meta")


def open_meta(spark: SparkSession, folder: str) -> dict[str, str]:
    return {r["k"]: r["v"] for r in spark.read.parquet(f"{folder}/meta").collect()}  # two rows


def build(notes: DataFrame, excluded: list[str] = EXCLUDED) -> tuple[Graph, DataFrame]:
    """(graph, meta) of `notes`: links keep their whole text as raw, tags come from the body.

    A name with a slash means the first note that ends in it, else what its last part means; a
    plain name the first note of that name; notes of excluded places are invisible. The note of a
    folder is looked up by name anywhere.
    """
    path = F.col("path")
    p = cut(_parsed(notes.filter(~prefixed(path, excluded) & ~path.isin(EXCLUDED_FILES))))
    fm = F.col("fm")
    name = T.nfc(T.path_name(path))
    node = p.select("path", name.alias("name"), T.path_zone(path).alias("zone"), T.path_dir(path).alias("dir"), _get(fm, r"(?md)^type:[ \t]*(.+)$").alias("type"), T.strip(F.coalesce(_get(fm, r"(?md)^summary:[ \t]*(.+)$"), F.lit(""))).alias("summary"), _get(fm, r"(?md)^created:[ \t]*(.+)$").alias("created"), F.octet_length("text").cast("bigint").alias("bytes"))
    live = node.groupBy(F.col("name").alias("key")).agg(F.min("path").alias("by_name"))
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    ends = F.when(F.size(parts) > 2, F.filter(ends, lambda x: x.contains("/"))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(F.array("path"), ends, F.transform(F.filter(ends, lambda x: x.endswith(".md")), lambda x: F.regexp_replace(x, r"\.md\z", "")))
    by_end = node.select("path", F.explode(keys).alias("end")).groupBy("end").agg(F.min("path").alias("by_end"))

    def listed(kind: str, column: str) -> DataFrame:
        return p.select(path.alias("src"), F.lit(kind).alias("kind"), F.explode(column).alias("raw"))

    p = p.withColumn("builds_on", L.fm_list(fm, "builds_on")).withColumn("supersedes", L.fm_list(fm, "supersedes"))
    asked = listed("builds_on", "builds_on").unionByName(listed("supersedes", "supersedes")).unionByName(listed("links_to", "raw_links"))
    asked = cut(asked.withColumn("end", L.link_target(F.col("raw"))).filter("kind <> 'links_to' OR end <> ''"))
    asked = asked.withColumn("key", F.when(F.col("end").contains("/"), T.path_name(F.col("end"))).otherwise(F.col("end")))
    rows = asked.count()
    found = skew_join(asked, live, "key", "left", heavy_keys(asked, "key", rows=rows))
    paths = found.withColumn("end", F.when(F.col("end").contains("/"), F.col("end")))
    found = skew_join(paths, by_end, "end", "left", heavy_keys(paths, "end", rows=rows))
    edge = found.select("src", F.coalesce("by_end", "by_name").alias("dst"), "raw", "kind")
    folders = node.filter("dir <> ''").select(path.alias("src"), F.element_at(F.split("dir", "/"), -1).alias("raw")).withColumn("key", T.nfc(F.col("raw")))
    part_of = folders.join(live, "key").filter("by_name <> src").select("src", F.col("by_name").alias("dst"), "raw", F.lit("part_of").alias("kind"))
    tag = p.select("path", F.explode(L.nested_tags(F.col("body"))).alias("tag"))
    spark = notes.sparkSession
    meta = spark.range(1).select(F.explode(F.array(F.struct(F.lit("built").alias("k"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("v")), F.struct(F.lit("excluded").alias("k"), F.lit(" ".join(excluded)).alias("v")))).alias("m")).select("m.k", "m.v")
    return Graph(node, cut(edge.unionByName(part_of)), tag), meta


def older_lint(spark: SparkSession, d: str) -> DataFrame:
    return lint(vault_notes(spark, d), vault_targets(spark, d))


def older_totals(spark: SparkSession, d: str) -> DataFrame:
    return link_totals(vault_notes(spark, d), vault_targets(spark, d))


def older_edge(spark: SparkSession, d: str) -> DataFrame:
    return build(vault_notes(spark, d))[0].edge.groupBy("src", "dst", "raw", "kind").agg(F.count(F.lit(1)).alias("n"))


def tag_notes(spark: SparkSession, d: str) -> DataFrame:
    """path, text: a note for each path of the tag table whose body holds its tags, one on a line, as the older tool wanted them."""
    word = F.regexp_replace(F.regexp_replace("tag", r"(?U)^[\s#]+|\s+$", ""), r"(?U)\s+", "-")
    tags = table(spark, d, "tag").filter("path IS NOT NULL AND tag IS NOT NULL").groupBy("path").agg(F.array_sort(F.collect_set(word)).alias("tags"))
    return tags.select("path", F.concat(F.lit("# tags\n"), F.array_join(F.transform("tags", lambda x: F.concat(F.lit("see #"), x)), "\n")).alias("text"))


def older_tag(spark: SparkSession, d: str) -> DataFrame:
    """The nested tags in the bodies of the documents and of notes made of the tag table."""
    notes = vault_notes(spark, d).unionByName(tag_notes(spark, d))
    return build(notes)[0].tag.groupBy("path", "tag").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (older_lint, older_totals, older_edge, older_tag)}

_BASE = "string_split({}, '/')[-1]"
_CUT = f"nfc_normalize({_TRIM.format('''regexp_replace(regexp_extract({}, '^((?s:.*?))(?:\\\\\\||\\||#|\\^|$)', 1), '\\\\+$', '')''')})"


def _listed(key: str) -> str:
    block = f"regexp_extract(coalesce(fm, '') || chr(10), '(?m)^{key}:\\n((?:[ \\t]+- .*\\n)+)', 1)"
    item = f"regexp_replace(trim({_TRIM.format('substr(' + _TRIM.format('x') + ', 3)')}, chr(34) || chr(39)), '^\\[\\[|\\]\\]$', '', 'g')"
    return f"list_transform(list_filter(string_split({block}, chr(10)), lambda x: x <> ''), lambda x: {item})"


def _prefixed(path: str, prefixes: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({path}, '{p}')" for p in prefixes) + ")"


#: The older reading in SQL. In the test tables a fence closes with its own marker, so code is found as in PARSED.
_OLD = f"""{PARSED},
old AS (SELECT path, text, fm, code_free, {_listed('builds_on')} AS ups, {_listed('supersedes')} AS instead,
  list_transform(list_filter(regexp_extract_all(code_free, '(\\\\?)\\[\\[[^\\[\\]\\n]+\\]\\]', 0), lambda x: NOT starts_with(x, chr(92))), lambda x: substr(x, 3, length(x) - 4)) AS raws FROM parsed)"""
_OLD_EDGES = f"""{_OLD},
live AS (SELECT *, nfc_normalize(regexp_replace({_BASE.format('path')}, '\\.md$', '')) AS name, {_DIR} AS dir, string_split(path, '/') AS p FROM old WHERE NOT {_prefixed('path', EXCLUDED)} AND path NOT IN ('CLAUDE.md')),
names AS (SELECT name AS k, min(path) AS dst FROM live GROUP BY name),
tails AS (SELECT path, array_to_string(p[i:], '/') AS e FROM (SELECT path, p, unnest(range(2, len(p))) AS i FROM live WHERE len(p) > 2)),
ends AS (SELECT e, min(path) AS dst FROM (SELECT path, path AS e FROM live UNION SELECT path, e FROM tails UNION SELECT path, regexp_replace(e, '\\.md$', '') FROM tails) GROUP BY e),
asked AS (SELECT src, kind, raw, {_CUT.format('raw')} AS e FROM (
  SELECT path AS src, 'builds_on' AS kind, unnest(ups) AS raw FROM live UNION ALL SELECT path, 'supersedes', unnest(instead) FROM live UNION ALL SELECT path, 'links_to', unnest(raws) FROM live)),
joined AS (SELECT src, coalesce(CASE WHEN contains(a.e, '/') THEN x.dst END, n.dst) AS dst, raw, kind FROM asked a
  LEFT JOIN names n ON n.k = CASE WHEN contains(a.e, '/') THEN regexp_replace({_BASE.format('a.e')}, '\\.md$', '') ELSE a.e END LEFT JOIN ends x ON x.e = a.e WHERE kind <> 'links_to' OR a.e <> ''
  UNION ALL SELECT path, n.dst, {_BASE.format('dir')}, 'part_of' FROM live l JOIN names n ON n.k = nfc_normalize({_BASE.format('dir')}) WHERE dir <> '' AND n.dst <> path)"""
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_SHOWN = "regexp_replace(regexp_replace(x, '\\]\\([^)]*\\)', ']()', 'g'), 'https?://\\S+', '', 'g')"
_JUNK = f"""flatten(list_transform(list_transform(string_split(code_free, chr(10)), lambda x: {_SHOWN}), lambda x: CASE WHEN {_TRIM.format("regexp_replace(x, '#[0-9a-zA-Z_/-]+', '', 'g')")} = '' THEN [] ELSE
  list_transform(list_filter(regexp_extract_all(x, '(?:^|[^\\p{{L}}\\p{{N}}_`\\\\])#([0-9a-zA-Z_-]{{2,}}/?)', 1), lambda y: NOT ends_with(y, '/') AND regexp_matches(y, '^[\\p{{L}}\\p{{N}}_]*[a-zA-Z]')), lambda y: '#' || y) END))"""
_FIELD = "CASE WHEN regexp_matches(fm, '(?m)^{0}:\\s*(\\S+)\\s*$') THEN regexp_extract(fm, '(?m)^{0}:\\s*(\\S+)\\s*$', 1) END"
_OLD_LINT = f"""{_OLD},
fields AS (SELECT *, {_FIELD.format('type')} AS t, {_FIELD.format('created')} AS created,
  CASE WHEN regexp_matches(fm, '(?m)^summary:[ \\t]*(.+)$') THEN trim({_TRIM.format("regexp_extract(fm, '(?m)^summary:[ \\t]*(.+)$', 1)")}, chr(34) || chr(39)) END AS s, {_prefixed('path', IGNORED_SOURCES)} AS skip FROM old),
checked AS (SELECT * FROM fields WHERE NOT skip),
targets AS (SELECT path FROM node WHERE path IS NOT NULL UNION SELECT path FROM files),
tails AS (SELECT array_to_string(p[i:], '/') AS k FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT string_split(path, '/') AS p FROM targets))),
known AS (SELECT k FROM tails UNION SELECT regexp_replace(k, '\\.md$', '') FROM tails WHERE k LIKE '%.md'),
found AS (
  SELECT path, 0 AS part, 0 AS pos, 'frontmatter 없음' AS code, '' AS detail FROM checked WHERE fm IS NULL
  UNION ALL SELECT path, 0, 1, 'type 없음', '' FROM checked WHERE fm IS NOT NULL AND t IS NULL UNION ALL SELECT path, 0, 2, 'type가 13값 밖', t FROM checked WHERE t NOT IN ({_IN(TYPES)})
  UNION ALL SELECT path, 0, 3, 'summary ' || length(s) || '자 (상한 {SUMMARY_MAX})', substr(s, 1, 40) || '…' FROM checked WHERE length(s) > {SUMMARY_MAX}
  UNION ALL SELECT path, 0, 4, 'created 없음', '' FROM checked WHERE fm IS NOT NULL AND created IS NULL UNION ALL SELECT path, 0, 5, 'created 형식 오류', created FROM checked WHERE created IS NOT NULL AND NOT {_ISO}
  UNION ALL SELECT path, 0, 6, 'builds_on ' || len(ups) || '개 (상한 {BUILDS_ON_MAX})', '' FROM checked WHERE len(ups) > {BUILDS_ON_MAX}
  UNION ALL SELECT path, 1, pos, 'builds_on 미해결', raw FROM (SELECT path, generate_subscripts(ups, 1) AS pos, unnest(ups) AS raw FROM checked) WHERE {_CUT.format('raw')} NOT IN (SELECT k FROM known)
  UNION ALL SELECT path, 2, pos, '의도치 않은 태그', j FROM (SELECT path, generate_subscripts(junk, 1) AS pos, unnest(junk) AS j FROM (SELECT path, {_JUNK} AS junk FROM checked WHERE fm IS NOT NULL))
  UNION ALL SELECT path, 3, pos, 'link', e FROM (SELECT path, pos, {_CUT.format('raw')} AS e FROM (SELECT path, generate_subscripts(raws, 1) AS pos, unnest(raws) AS raw FROM checked))
    WHERE e <> '' AND e NOT IN ({_IN(IGNORED_TARGETS)}) AND NOT regexp_matches(e, '{L.PLACEHOLDER}') AND e NOT IN (SELECT k FROM known))"""
SQL = {
    "older_edge": f"WITH {_OLD_EDGES} SELECT src, dst, raw, kind, count(*) AS n FROM joined GROUP BY ALL",
    "older_tag": f"""WITH {_OLD}, words AS (SELECT DISTINCT path, regexp_replace(regexp_replace(tag, '^[\\s#]+|\\s+$', '', 'g'), '\\s+', '-', 'g') AS w FROM tag WHERE path IS NOT NULL AND tag IS NOT NULL),
bodies AS (SELECT path, code_free AS body FROM parsed UNION ALL SELECT path, ' #' || w FROM words),
nested AS (SELECT path, unnest(regexp_extract_all(body, '(?:^|[^\\p{{L}}\\p{{N}}_`\\\\])#([A-Za-z가-힣][0-9a-zA-Z가-힣_-]*(?:/[0-9a-zA-Z가-힣_-]+)+)', 1)) AS tag FROM bodies WHERE NOT {_prefixed('path', EXCLUDED)} AND path <> 'CLAUDE.md')
SELECT path, tag, count(*) AS n FROM nested GROUP BY ALL""",
    "older_totals": f"""WITH {_OLD_LINT.split('found AS (')[0].rstrip().rstrip(',')},
asked AS (SELECT path, skip, {_CUT.format('raw')} AS e FROM (SELECT path, skip, unnest(raws) AS raw FROM fields)),
judged AS (SELECT e NOT IN (SELECT k FROM known) AS dead, skip OR e IN ({_IN(IGNORED_TARGETS)}) OR regexp_matches(e, '{L.PLACEHOLDER}') AS exempt FROM asked WHERE e <> '')
SELECT 'links' AS measure, count(*) AS n FROM judged UNION ALL SELECT 'broken', count(*) FROM judged WHERE dead AND NOT exempt UNION ALL SELECT 'exempt', count(*) FROM judged WHERE dead AND exempt""",
    "older_lint": f"WITH {_OLD_LINT} SELECT path, code, detail, CAST(row_number() OVER (PARTITION BY path ORDER BY part, pos) - 1 AS INTEGER) AS seq FROM found",
}
