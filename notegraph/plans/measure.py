"""Measurements of a corpus, over all notes and over those of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions import text as T
from notegraph.operators.resolve import case_collisions, duplicate_names, resolve
from notegraph.plans.build import _TARGET, EXCLUDED_ZONES, LINKS, PARSED, RESOLVED, parse, vault_notes, vault_targets
from notegraph.plans.lint import SUMMARY_MAX, TYPES
from notegraph.session import cut

#: What the measurements look for in a text.
BLANK_IN_BLOCK = r"(?md)^[a-z_]+:[ \t]*\n\n[ \t]+- "
TILDE_FENCE = r"(?md)^[ \t]*~~~"
LONG_FENCE = r"(?md)^[ \t]*(`{4,}|~{4,})"
DOUBLE_TICK = r"(?<!`)``(?!`)"


def _long(df: DataFrame, scope: str) -> DataFrame:
    """One row of sums as rows (scope, measure, n)."""
    rows = [F.struct(F.lit(c).alias("measure"), F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("n")) for c in df.columns]
    return df.select(F.lit(scope).alias("scope"), F.explode(F.array(*rows)).alias("r")).select("scope", "r.measure", "r.n")


def _scopes(parsed: DataFrame, sums: dict, path: str = "path") -> DataFrame:
    """The sums over all rows and over those in the graph's zones, in one pass."""
    inside = ~T.under(F.col(path), EXCLUDED_ZONES)
    whole = [F.sum(v.cast("bigint")).alias(f"all_{k}") for k, v in sums.items()] + [F.sum(F.when(inside, v.cast("bigint"))).alias(f"zone_{k}") for k, v in sums.items()]
    one = parsed.agg(*whole)
    rows = [F.struct(F.lit(s).alias("scope"), F.lit(k).alias("measure"), F.coalesce(F.col(f"{s}_{k}"), F.lit(0)).alias("n")) for s in ("all", "zone") for k in sums]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.scope", "r.measure", "r.n")


def fields(notes: DataFrame) -> DataFrame:
    """scope, measure, n: how many notes have which fields."""
    p = parse(notes)
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False)).cast("int")
    sums = {"files": F.lit(1), "frontmatter": F.col("fm").isNotNull().cast("int"), "type": has("type"), "summary": has("summary"), "blank line in a block": F.coalesce(F.col("fm").rlike(BLANK_IN_BLOCK), F.lit(False)).cast("int")}
    for k in ("builds_on", "supersedes"):
        sums |= {f"{k} docs": (F.size(k) > 0).cast("int"), f"{k} items": F.size(k)}
    return _scopes(p, sums)


def summary_lengths(notes: DataFrame) -> DataFrame:
    """least, median, p95, most, over of the lengths of summaries: the values at place n/2 and 0.95 n, from 0.

    Lengths are counted first; their histogram has one row for each length.
    """
    p = parse(notes).filter("summary <> ''").groupBy(F.length("summary").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    total = p.agg(F.sum("n").alias("total"))
    from pyspark.sql import Window

    upto = F.sum("n").over(Window.orderBy("len"))  # the histogram of lengths, not the notes
    h = p.withColumn("upto", upto).crossJoin(F.broadcast(total))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("len")))
    return h.agg(
        F.min("len").alias("least"), at(F.floor(F.col("total") / 2)).alias("median"), at(F.floor(F.col("total") * 0.95)).alias("p95"), F.max("len").alias("most"),
        F.coalesce(F.sum(F.when(F.col("len") > SUMMARY_MAX, F.col("n"))), F.lit(0)).alias("over"),
    )


def type_histogram(notes: DataFrame) -> DataFrame:
    """type, n, known."""
    return parse(notes).filter("type <> ''").groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("known", F.col("type").isin(TYPES))


def links(notes: DataFrame) -> DataFrame:
    """scope, measure, n: links, separators and forms of code."""
    p = parse(notes)
    cut_items = F.filter(F.concat("builds_on", "supersedes"), lambda x: T.link_target(x) != x)
    has = lambda pattern: F.col("text").rlike(pattern).cast("int")
    return _scopes(p, {
        "notes": F.lit(1), "links": F.size("links"), "linking notes": (F.size("links") > 0).cast("int"), "listed edges": F.size("builds_on") + F.size("supersedes"),
        "listed edges that are cut": F.size(cut_items), "names that would be cut": T.path_name(F.col("path")).rlike(r"[|#^]").cast("int"), "notes with ~~~": has(TILDE_FENCE),
        "notes with longer fences": has(LONG_FENCE), "notes with double ticks": has(DOUBLE_TICK), "notes with links above the body": (F.size(T.links(F.col("text"))) != F.size("links")).cast("int"),
    })


def resolution(notes: DataFrame, targets: DataFrame) -> DataFrame:
    """scope, measure, n: links and frontmatter edges, and how many resolve nowhere."""
    from notegraph.plans.build import named_links

    named = cut(named_links(parse(notes)))
    r = resolve(named, targets, named.count())
    body, dead = (F.col("kind") == "links_to").cast("int"), F.col("landed").isNull().cast("int")
    return _scopes(r, {"links": body, "unresolved": body * dead, "edges": 1 - body, "edges unresolved": (1 - body) * dead}, "src")


def unresolved_targets(notes: DataFrame, targets: DataFrame, top: int = 20) -> DataFrame:
    """target, n: the most frequent unresolved targets (a report; ties by text)."""
    from notegraph.plans.build import named_links

    named = cut(named_links(parse(notes)))
    r = resolve(named, targets, named.count()).filter("landed IS NULL")
    return r.groupBy("target").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "target").limit(top)


#: What examples of links are called.
PLACEHOLDERS = ["...", "참조", "파일명", "제목", "경로", "예시"]


def unresolved_summary(notes: DataFrame, targets: DataFrame) -> DataFrame:
    """measure, n: different unresolved targets, how often they are written, and how often as a placeholder."""
    from notegraph.plans.build import named_links

    named = cut(named_links(parse(notes)))
    r = resolve(named, targets, named.count()).filter("landed IS NULL").groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return _long(r.agg(F.count(F.lit(1)).alias("targets"), F.sum("n").alias("hits"), F.sum(F.when(F.col("target").isin(PLACEHOLDERS), F.col("n"))).alias("placeholders")), "").drop("scope")


def names(targets: DataFrame) -> DataFrame:
    """measure, n: names of several files, their files, groups that differ in case, names not in NFC."""
    d = duplicate_names(targets).agg(F.count(F.lit(1)).alias("duplicate names"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate files"))
    c = case_collisions(targets).agg(F.count(F.lit(1)).alias("case collisions"))
    base = F.element_at(F.split("path", "/"), -1)
    n = targets.filter(T.is_note(F.col("path"))).agg(F.count_if(base != T.nfc(base)).alias("names not in NFC"))
    return _long(d, "").unionByName(_long(c, "")).unionByName(_long(n, "")).drop("scope")


QUERIES = {
    "measure_fields": lambda s, d: fields(vault_notes(s, d)),
    "measure_summary": lambda s, d: summary_lengths(vault_notes(s, d)),
    "measure_types": lambda s, d: type_histogram(vault_notes(s, d)),
    "measure_links": lambda s, d: links(vault_notes(s, d)),
    "measure_resolution": lambda s, d: resolution(vault_notes(s, d), vault_targets(s, d)),
    "measure_unresolved": lambda s, d: unresolved_targets(vault_notes(s, d), vault_targets(s, d)),
    "measure_unresolved_summary": lambda s, d: unresolved_summary(vault_notes(s, d), vault_targets(s, d)),
    "measure_names": lambda s, d: names(vault_targets(s, d)),
    "duplicate_names": lambda s, d: duplicate_names(vault_targets(s, d)).withColumn("paths", F.array_join("paths", "|")),
    "case_collisions": lambda s, d: case_collisions(vault_targets(s, d)).withColumn("names", F.array_join("names", "|")),
}

_ZONE = "NOT (starts_with({0}, '800 TRPG/') OR starts_with({0}, '900 Archive/') OR {0} IN ('800 TRPG', '900 Archive'))"


def _measures(source: str, path: str, sums: dict[str, str], ctes: str = PARSED) -> str:
    parts = [f"SELECT '{s}' AS scope, '{k}' AS measure, CAST(coalesce(sum(({v})::BIGINT), 0) AS BIGINT) AS n FROM {source}" + (f" WHERE {_ZONE.format(path)}" if s == "zone" else "") for s in ("all", "zone") for k, v in sums.items()]
    return f"WITH {ctes} " + " UNION ALL ".join(parts)


_NAMES = """
t AS (SELECT path FROM node WHERE path IS NOT NULL UNION SELECT coalesce(path, 'inbox/doc' || doc_id || '.md') FROM documents WHERE text IS NOT NULL),
k AS (SELECT string_split(path, '/')[-1] AS key, path FROM t UNION SELECT regexp_replace(string_split(path, '/')[-1], '\\.md$', ''), path FROM t WHERE path LIKE '%.md'),
dup AS (SELECT key, array_to_string(list_sort(list(path)), '|') AS paths, count(*) AS n FROM k GROUP BY key HAVING count(*) > 1)"""
SQL = {
    "measure_fields": _measures("parsed", "path", {
        "files": "1", "frontmatter": "fm IS NOT NULL", "type": "coalesce(type, '') <> ''", "summary": "coalesce(summary, '') <> ''",
        "blank line in a block": "coalesce(regexp_matches(fm, '(?m)^[a-z_]+:[ \\t]*\\n\\n[ \\t]+- '), false)",
        "builds_on docs": "len(builds_on) > 0", "builds_on items": "len(builds_on)", "supersedes docs": "len(supersedes) > 0", "supersedes items": "len(supersedes)"}),
    "measure_summary": f"""WITH {PARSED}, l AS (SELECT list_sort(list(length(summary))) AS x FROM parsed WHERE summary <> '')
SELECT CAST(x[1] AS INTEGER) AS least, CAST(x[CAST(floor(len(x) / 2) AS BIGINT) + 1] AS INTEGER) AS median, CAST(x[CAST(floor(len(x) * 0.95) AS BIGINT) + 1] AS INTEGER) AS p95, CAST(x[-1] AS INTEGER) AS most, len(list_filter(x, lambda v: v > {SUMMARY_MAX})) AS "over" FROM l""",
    "measure_types": f"WITH {PARSED} SELECT type, count(*) AS n, type IN ({', '.join(repr(t) for t in TYPES)}) AS known FROM parsed WHERE type <> '' GROUP BY type",
    "measure_links": _measures("measured", "path", {
        "notes": "1", "links": "len(links)", "linking notes": "len(links) > 0", "listed edges": "len(builds_on) + len(supersedes)",
        "listed edges that are cut": f"len(list_filter(list_concat(builds_on, supersedes), lambda x: {_TARGET.format('x')} <> x))",
        "names that would be cut": "regexp_matches(regexp_replace(string_split(path, '/')[-1], '\\.md$', ''), '[|#^]')",
        "notes with ~~~": "regexp_matches(text, '(?m)^[ \\t]*~~~')", "notes with longer fences": "regexp_matches(text, '(?m)^[ \\t]*(`{4,}|~{4,})')",
        "notes with double ticks": "regexp_matches(text, '(?:^|[^`])``(?:[^`]|$)')", "notes with links above the body": "len(whole_links) <> len(links)"}, f"""{PARSED},
  all_lines AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM halves),
  all_fenced AS (SELECT *, regexp_matches(line, '^[ \\t]*(```|~~~)') AS fence, sum(CASE WHEN regexp_matches(line, '^[ \\t]*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos) AS n FROM all_lines),
  all_clean AS (SELECT path, string_agg(CASE WHEN fence OR n % 2 = 1 THEN '' ELSE regexp_replace(line, '`[^`]*`', '', 'g') END, chr(10) ORDER BY pos) AS t FROM all_fenced GROUP BY path),
  measured AS (SELECT p.*, {LINKS.format('t')} AS whole_links FROM parsed p JOIN all_clean c ON c.path = p.path)"""),
    "measure_resolution": _measures("landed", "src", {"links": "kind = 'links_to'", "unresolved": "kind = 'links_to' AND landed IS NULL", "edges": "kind <> 'links_to'", "edges unresolved": "kind <> 'links_to' AND landed IS NULL"}, f"{PARSED}, {RESOLVED}"),
    "measure_unresolved": f"WITH {PARSED}, {RESOLVED} SELECT target, count(*) AS n FROM landed WHERE landed IS NULL GROUP BY target ORDER BY n DESC, target LIMIT 20",
    "measure_unresolved_summary": f"""WITH {PARSED}, {RESOLVED}, u AS (SELECT target FROM landed WHERE landed IS NULL)
SELECT 'targets' AS measure, count(DISTINCT target) AS n FROM u UNION ALL SELECT 'hits', count(*) FROM u UNION ALL SELECT 'placeholders', count(*) FROM u WHERE target IN ({', '.join(repr(x) for x in PLACEHOLDERS)})""",
    "measure_names": f"""WITH {_NAMES} SELECT 'duplicate names' AS measure, count(*) AS n FROM dup UNION ALL SELECT 'duplicate files', CAST(coalesce(sum(n), 0) AS BIGINT) FROM dup
UNION ALL SELECT 'case collisions', count(*) FROM (SELECT lower(key) FROM k GROUP BY lower(key) HAVING count(DISTINCT key) > 1)
UNION ALL SELECT 'names not in NFC', count(*) FROM t WHERE path LIKE '%.md' AND string_split(path, '/')[-1] <> nfc_normalize(string_split(path, '/')[-1])""",
    "case_collisions": f"""WITH {_NAMES}, folded AS (SELECT DISTINCT replace(lower(key), 'ß', 'ss') AS folded, key FROM k)
SELECT folded, array_to_string(list_sort(list(key)), '|') AS names FROM folded GROUP BY folded HAVING count(*) > 1""",
    "duplicate_names": f"WITH {_NAMES} SELECT key, paths, n FROM dup",
}
