"""From texts to the graph: node, edge and tag tables, built anew each time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions import text as T
from notegraph.operators.resolve import resolve
from notegraph.operators.skew import heavy_keys, skew_join
from notegraph.session import cut
from notegraph.sources.tables import dealt, table

#: Configuration: zones and files that are no part of the graph unless `build` is told others; links into them stay unresolved.
EXCLUDED_ZONES = ["800 TRPG", "900 Archive"]
EXCLUDED_FILES = ["CLAUDE.md"]


#: Ids of superseded documents that are broadcast at most (8 MB).
SUPERSEDED = 1_000_000


@dataclass(frozen=True)
class Graph:
    node: DataFrame
    edge: DataFrame
    tag: DataFrame

    def write(self, folder: str) -> None:
        """Overwrite the three tables below `folder`; edges lie by kind."""
        self.node.write.mode("overwrite").parquet(f"{folder}/node")
        self.edge.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/edge")
        self.tag.write.mode("overwrite").parquet(f"{folder}/tag")

    def views(self) -> None:
        """Register the tables for SQL."""
        for name in ("node", "edge", "tag"):
            getattr(self, name).createOrReplaceTempView(name)


def open_graph(spark: SparkSession, folder: str) -> Graph:
    """The graph that `write` left; a missing one raises."""
    return Graph(*(spark.read.parquet(f"{folder}/{t}") for t in ("node", "edge", "tag")))


def parse(notes: DataFrame) -> DataFrame:
    """`notes` (path, text) with fm, body, the scalar and list fields, links and body tags."""
    text = T.universal_newlines(F.col("text"))
    split = notes.withColumn("text", text).withColumn("fm", T.frontmatter(F.col("text"))).withColumn("body", T.body(F.col("text")))
    fm = F.col("fm")
    return split.select(
        "*",
        *[T.fm_get(fm, k).alias(k) for k in ("type", "summary", "created")],
        *[T.fm_list(fm, k).alias(k) for k in ("builds_on", "supersedes", "tags")],
        T.links(F.col("body")).alias("links"),
    )


def in_graph(path, zones: list[str] = EXCLUDED_ZONES, files: list[str] = EXCLUDED_FILES) -> F.Column:
    return ~path.isin(list(files)) & ~T.under(path, list(zones))


def named_links(parsed: DataFrame) -> DataFrame:
    """src, kind, seq, target of all links of a note: its lists first, then its body."""
    def of_kind(kind: str, column: str, target):
        return F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), target(x).alias("target")))

    lists = [of_kind(k, k, T.link_target) for k in ("builds_on", "supersedes")] + [of_kind("links_to", "links", lambda x: x)]
    return parsed.select(F.col("path").alias("src"), F.posexplode(F.concat(*lists)).alias("seq", "l")).select("src", "l.kind", "seq", "l.target")


def folder_notes(node: DataFrame) -> DataFrame:
    """src, dst, raw, kind: the note that stands for a note's folder, inside it or beside it."""
    own = node.filter("dir <> ''").select("path", "dir", F.element_at(F.split("dir", "/"), -1).alias("name"))
    above = F.regexp_extract("dir", r"\A((?s:.*)/)[^/]*\z", 1)
    asked = own.select("dir", "name").distinct().select("dir", "name", F.posexplode(F.array(F.concat("dir", F.lit("/"), "name", F.lit(".md")), F.concat(above, "name", F.lit(".md")))).alias("turn", "dst"))
    found = asked.join(node.select(F.col("path").alias("dst")), "dst", "left_semi")
    # a folder's note inside comes first, unless the note itself is that
    both = found.groupBy("dir", "name").agg(F.array_sort(F.collect_list(F.struct("turn", "dst"))).alias("c"))
    joined = own.join(both, ["dir", "name"]).withColumn("c", F.filter("c", lambda x: x["dst"] != F.col("path")))
    return joined.filter(F.size("c") > 0).select(F.col("path").alias("src"), F.col("c")[0]["dst"].alias("dst"), F.col("name").alias("raw"), F.lit("part_of").alias("kind"))


def build(notes: DataFrame, targets: DataFrame, bytes_column: str | None = None, zones: list[str] = EXCLUDED_ZONES, files: list[str] = EXCLUDED_FILES) -> Graph:
    """The graph of `notes` (path unique, text) but for those of the excluded `zones` and `files`.

    targets: path of every file a link may mean, notes and attachments, also those outside the
    graph. An unresolved link keeps its text as raw and has no dst; a link to an attachment is
    none. Null paths and texts are no notes.
    """
    size = F.col(bytes_column) if bytes_column else F.octet_length("text")
    inside = notes.filter(F.col("path").isNotNull() & F.col("text").isNotNull() & in_graph(F.col("path"), zones, files)).withColumn("bytes", size.cast("bigint"))
    parsed = cut(parse(inside.select("path", "text", "bytes")).drop("text", "fm", "body"))
    path = F.col("path")
    node = parsed.select("path", T.path_name(path).alias("name"), T.path_zone(path).alias("zone"), T.path_dir(path).alias("dir"), "type", "summary", "created", "bytes")
    named = named_links(parsed)
    rows = named.count()
    landed = cut(resolve(named, targets, rows))
    attached = (F.col("kind") == "links_to") & F.col("landed").isNotNull() & ~T.is_note(F.col("landed"))
    inside_dst = F.when(in_graph(F.col("landed"), zones, files) & T.is_note(F.col("landed")), F.col("landed"))
    known = node.select(F.col("path").alias("dst"), F.lit(True).alias("is_node"))
    edges = landed.filter(~F.coalesce(attached, F.lit(False))).select("src", inside_dst.alias("dst"), F.col("target").alias("raw"), "kind")
    edges = skew_join(edges, known, "dst", "left", heavy_keys(edges, "dst", rows=rows)).select("src", F.when(F.col("is_node"), F.col("dst")).alias("dst"), "raw", "kind")
    tag = parsed.select("path", F.explode("tags").alias("tag"))
    return Graph(node, cut(edges.unionByName(folder_notes(node))), tag)


def vault_notes(spark: SparkSession, d: str) -> DataFrame:
    """path, text: the texts of `documents` as files; of several of one path the one captured last."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    path = F.coalesce("path", F.concat(F.lit("inbox/doc"), F.col("doc_id").cast("string"), F.lit(".md")))
    docs = docs.select(path.alias("path"), "doc_id", "captured_at", "text")
    whole = dealt(docs.select("path", "doc_id", "text"), "doc_id")
    # only ids and times are shuffled, not the texts: few documents have a later one of their path
    last = docs.groupBy("path").agg(F.max(F.struct("captured_at", "doc_id"))["doc_id"].alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    older = cut(docs.select("path", "doc_id").join(last, "path").filter("doc_id <> last").select("doc_id"))
    small = older.count() <= SUPERSEDED
    return whole.join(F.broadcast(older) if small else older, "doc_id", "left_anti").select("path", "text")


def vault_targets(spark: SparkSession, d: str) -> DataFrame:
    """path: all files a link may mean."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    path = F.coalesce("path", F.concat(F.lit("inbox/doc"), F.col("doc_id").cast("string"), F.lit(".md")))
    return table(spark, d, "node").select("path").union(docs.select(path.alias("path"))).distinct()


def vault_graph(spark: SparkSession, d: str) -> Graph:
    return build(vault_notes(spark, d), vault_targets(spark, d))


def build_node(spark: SparkSession, d: str) -> DataFrame:
    return vault_graph(spark, d).node


def build_edge(spark: SparkSession, d: str) -> DataFrame:
    return vault_graph(spark, d).edge.groupBy("src", "dst", "raw", "kind").agg(F.count(F.lit(1)).alias("n"))


def build_tag(spark: SparkSession, d: str) -> DataFrame:
    return vault_graph(spark, d).tag.groupBy("path", "tag").agg(F.count(F.lit(1)).alias("n"))


def build_stats(spark: SparkSession, d: str) -> DataFrame:
    from notegraph.plans.catalog import stats

    return stats(vault_graph(spark, d))


def parse_notes(spark: SparkSession, d: str) -> DataFrame:
    """What the text functions read from each note."""
    p = parse(vault_notes(spark, d))
    return p.select(
        "path", F.col("fm").isNotNull().alias("has_fm"), F.length("body").alias("body_length"), "type", "summary", "created",
        *[F.array_join(k, "|").alias(k) for k in ("builds_on", "supersedes", "tags")], F.array_join("links", "|").alias("links"),
        F.array_join(T.body_tags(F.col("body")), "|").alias("body_tags"), F.length(T.strip_code(F.col("body"))).alias("code_free_length"),
    )


QUERIES = {f.__name__: f for f in (parse_notes, build_node, build_edge, build_tag, build_stats)}

_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_ITEM = f"trim({_TRIM.format('substr(' + _TRIM.format('x') + ', 2)')}, chr(34) || chr(39))"


def _get(key: str) -> str:
    return f"CASE WHEN regexp_matches(fm, '(?m)^{key}:[ \\t]*(.+)$') THEN trim({_TRIM.format(f'''regexp_extract(fm, '(?m)^{key}:[ \\t]*(.+)$', 1)''')}, chr(34) || chr(39)) END"


def _list(key: str) -> str:
    block = f"regexp_extract(fm, '(?m)^{key}:[ \\t]*\\n((?:[ \\t]+-[ \\t].*\\n?)+)', 1)"
    items = f"list_transform(list_filter(string_split({block}, chr(10)), lambda x: x <> ''), lambda x: {_ITEM})"
    return f"coalesce(list_transform({items}, lambda x: CASE WHEN regexp_matches(x, '^\\[\\[(?s:.*)\\]\\]$') THEN substr(x, 3, length(x) - 4) ELSE x END), [])"


_TARGET = _TRIM.format("regexp_extract({}, '^((?s:.*?))(?:\\\\\\||\\||#|\\^|$)', 1)")
#: The targets of the links in a text without code.
LINKS = f"""list_filter(list_transform(list_filter(regexp_extract_all({{}}, '(\\\\?)!?\\[\\[[^\\[\\]]+\\]\\]', 0), lambda x: NOT starts_with(x, chr(92))),
    lambda x: {_TARGET.format("regexp_extract(x, '!?\\[\\[([^\\[\\]]+)\\]\\]', 1)")}), lambda x: x <> '')"""
#: The notes of the test tables, parsed in SQL. Code is found by a running sum over lines.
PARSED = f"""
files AS (SELECT coalesce(path, 'inbox/doc' || doc_id || '.md') AS path, arg_max(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), (captured_at, doc_id)) AS text
  FROM documents WHERE text IS NOT NULL GROUP BY 1),
halves AS (SELECT path, text, regexp_matches(text, '\\A---\\n(?s:.*?)\\n---') AS has_fm,
  CASE WHEN regexp_matches(text, '\\A---\\n(?s:.*?)\\n---') THEN regexp_extract(text, '\\A---\\n((?s:.*?))\\n---\\n?', 1) END AS fm,
  CASE WHEN regexp_matches(text, '\\A---\\n(?s:.*?)\\n---') THEN regexp_replace(text, '\\A---\\n(?s:.*?)\\n---\\n?', '') ELSE text END AS body FROM files),
lines AS (SELECT path, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM halves),
fenced AS (SELECT *, regexp_matches(line, '^[ \\t]*(```|~~~)') AS fence, sum(CASE WHEN regexp_matches(line, '^[ \\t]*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos) AS n FROM lines),
clean AS (SELECT path, string_agg(CASE WHEN fence OR n % 2 = 1 THEN '' ELSE regexp_replace(line, '`[^`]*`', '', 'g') END, chr(10) ORDER BY pos) AS code_free FROM fenced GROUP BY path),
parsed AS (SELECT h.path, h.text, has_fm, fm, body, code_free, {_get('type')} AS type, {_get('summary')} AS summary, {_get('created')} AS created,
  {_list('builds_on')} AS builds_on, {_list('supersedes')} AS supersedes, {_list('tags')} AS tags,
  {LINKS.format('code_free')} AS links,
  list_filter(list_transform(regexp_extract_all(code_free, '(?:^|\\s)#([\\p{{L}}\\p{{N}}_/-]+)', 1), lambda x: x), lambda x: regexp_matches(x, '\\p{{L}}')) AS body_tags
  FROM halves h JOIN clean c ON c.path = h.path)"""
_BASE = "string_split({}, '/')[-1]"
#: Links resolved in SQL.
RESOLVED = f"""
targets AS (SELECT path FROM node WHERE path IS NOT NULL UNION SELECT path FROM files),
parts AS (SELECT path, string_split(regexp_replace(path, '\\.md$', ''), '/') AS p FROM targets WHERE path LIKE '%.md'),
keys AS (SELECT {_BASE.format('path')} AS k, path FROM targets UNION SELECT array_to_string(p[i:], '/'), path FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
named AS (
  SELECT path AS src, 'builds_on' AS kind, {_TARGET.format('x')} AS target FROM (SELECT path, unnest(builds_on) AS x FROM parsed)
  UNION ALL SELECT path, 'supersedes', {_TARGET.format('x')} FROM (SELECT path, unnest(supersedes) AS x FROM parsed)
  UNION ALL SELECT path, 'links_to', unnest(links) FROM parsed),
asked AS (SELECT DISTINCT nfc_normalize(target) AS k, regexp_extract(src, '\\A((?s:.*))/[^/]*$', 1) AS dir FROM named),
answer AS (SELECT a.k, a.dir, arg_min(t.path, (CASE WHEN a.dir <> '' AND starts_with(t.path, a.dir || '/') THEN 0 ELSE 1 END, t.path)) AS landed FROM asked a JOIN keys t ON t.k = a.k GROUP BY ALL),
landed AS (SELECT n.*, landed FROM named n LEFT JOIN answer a ON a.k = nfc_normalize(n.target) AND a.dir = regexp_extract(n.src, '\\A((?s:.*))/[^/]*$', 1))"""
_IN = "({0} <> 'CLAUDE.md' AND {0} NOT IN ('800 TRPG', '900 Archive') AND NOT starts_with({0}, '800 TRPG/') AND NOT starts_with({0}, '900 Archive/'))"
_DIR = "regexp_extract(path, '\\A((?s:.*))/[^/]*$', 1)"
NODES = f"""
nodes AS (SELECT path, regexp_replace({_BASE.format('path')}, '\\.md$', '') AS name, string_split(path, '/')[1] AS zone, {_DIR} AS dir, type, summary, created, octet_length(encode(text)) AS bytes FROM parsed WHERE {_IN.format('path')})"""
EDGES = f"""
folder AS (SELECT path, dir, string_split(dir, '/')[-1] AS fname, regexp_extract(dir, '\\A((?s:.*)/)[^/]*$', 1) AS above FROM nodes WHERE dir <> ''),
cand AS (SELECT path, fname, 0 AS turn, dir || '/' || fname || '.md' AS dst FROM folder UNION ALL SELECT path, fname, 1, above || fname || '.md' FROM folder),
partof AS (SELECT c.path AS src, arg_min(c.dst, turn) AS dst, any_value(fname) AS raw, 'part_of' AS kind FROM cand c JOIN nodes n ON n.path = c.dst WHERE c.dst <> c.path GROUP BY c.path),
edges AS (
  SELECT src, n.path AS dst, target AS raw, kind FROM landed l LEFT JOIN nodes n ON n.path = l.landed
  WHERE {_IN.format('src')} AND NOT (kind = 'links_to' AND landed IS NOT NULL AND landed NOT LIKE '%.md')
  UNION ALL SELECT src, dst, raw, kind FROM partof)"""
GRAPH = f"{PARSED}, {RESOLVED}, {NODES}, {EDGES}, tags_t AS (SELECT path, unnest(tags) AS tag FROM parsed WHERE {_IN.format('path')})"
SQL = {
    "parse_notes": f"""WITH {PARSED} SELECT path, has_fm, CAST(length(body) AS INTEGER) AS body_length, type, summary, created, array_to_string(builds_on, '|') AS builds_on,
 array_to_string(supersedes, '|') AS supersedes, array_to_string(tags, '|') AS tags, array_to_string(links, '|') AS links, array_to_string(body_tags, '|') AS body_tags, CAST(length(code_free) AS INTEGER) AS code_free_length FROM parsed""",
    "build_node": f"WITH {GRAPH} SELECT * FROM nodes",
    "build_edge": f"WITH {GRAPH} SELECT src, dst, raw, kind, count(*) AS n FROM edges GROUP BY ALL",
    "build_tag": f"WITH {GRAPH} SELECT path, tag, count(*) AS n FROM tags_t GROUP BY ALL",
    "build_stats": f"""WITH {GRAPH}
SELECT 'total' AS section, 'node' AS key, count(*) AS n FROM nodes UNION ALL SELECT 'total', 'edge', count(*) FROM edges UNION ALL SELECT 'total', 'tag', count(*) FROM tags_t
UNION ALL SELECT 'total', 'unresolved', count(*) FROM edges WHERE dst IS NULL UNION ALL SELECT 'kind', kind, count(*) FROM edges GROUP BY kind""",
}
