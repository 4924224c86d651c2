"""Queries over the notes, links and tags of a vault."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions.looks import link_part
from notegraph.llm.canonical import canonical_rows, canonical_values
from notegraph.llm.cooccurrence import cooccurrence
from notegraph.llm.lookalikes import consistent_form, consistent_forms, differing_spellings, expand
from notegraph.llm.tags import tag_form
from notegraph.llm.term_counts import marks, term_counts
from notegraph.plans.integrity import sql_link, sql_looks
from notegraph.session import cut
from notegraph.sources.tables import table

#: Significance of 5 % for one degree of freedom.
SIGNIFICANT = 3.84


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tag").filter("tag IS NOT NULL").select("path", tag_form(F.col("tag")).alias("form"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs on at least 5 and 0.1 % of the notes, at least four times as often as by chance.

    At these bounds the log-likelihood ratio is above 6, so the significance test never drops one.
    """
    pairs = cooccurrence(_tagged(spark, d), "path", "form", min_count=5, min_share=0.001)
    far = (F.col("n") * F.col("total") >= 4 * F.col("n_a") * F.col("n_b")) & (F.col("n") >= 0.001 * F.col("total"))
    return pairs.filter(far & (F.col("llr") >= SIGNIFICANT)).select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of tags with its count, how much more often than by chance, and its significance."""
    return cooccurrence(_tagged(spark, d), "path", "form").select(
        F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"), (F.col("llr") >= SIGNIFICANT).alias("significant")
    )


def _types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "note_type").select(F.col("type_name").alias("entry"), "also")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical_rows(table(spark, d, "node"), "node_id", "type", _types(spark, d)).withColumnRenamed("entry", "type_name")


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct typed value with its entry and the slips it took; `?` marks the unmatched."""
    values = table(spark, d, "node").select(F.col("type").alias("value"))
    return canonical_values(values, _types(spark, d)).withColumnRenamed("entry", "type_name")


def _forms(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    node, edge = table(spark, d, "node"), table(spark, d, "edge")
    names = node.select(F.col("node_id").alias("id"), F.col("name").alias("value")).filter("value IS NOT NULL").distinct()
    paths = node.select(F.col("node_id").alias("id"), F.col("path").alias("value")).filter("value IS NOT NULL").distinct()
    links = edge.select(F.col("edge_id").alias("id"), link_part(F.col("raw")).alias("value")).filter("value IS NOT NULL").distinct()
    form = lambda df: cut(df.select("value").distinct().withColumn("form", consistent_form(spark, F.col("value"))))
    return names, paths, links, form(names), form(paths), form(links)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    names, paths, links, name_f, path_f, link_f = _forms(spark, d)
    stem = lambda c: F.regexp_replace(c, r"\.md\z", "")
    stems = paths.select("id", stem("value").alias("value"))
    stem_f = path_f.select(stem("value").alias("value"), stem("form").alias("form"))
    slash = F.col("value").contains("/")
    rows, found = table(spark, d, "edge").count() + table(spark, d, "node").count(), []
    for ids, forms in ((names, name_f), (paths, path_f)):
        pairs = differing_spellings(forms, forms).filter("value_a < value_b")
        found.append(expand(pairs, ids, ids, rows).filter("a <> b"))
    for ids, forms, which in ((names, name_f, ~slash), (stems, stem_f, slash)):
        pairs = differing_spellings(forms, link_f.filter(which))
        found.append(expand(pairs, ids, links.filter(which), rows))
    out = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    return out.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """kind, first, spellings, ids: each look that names, paths or links are spelled in several ways, by its first spelling."""
    names, paths, links, *forms = _forms(spark, d)
    classes = []
    for kind, ids, form in zip(("name", "path", "link"), (names, paths, links), forms):
        counted = ids.groupBy("value").agg(F.count(F.lit(1)).alias("n")).join(form, "value")
        several = counted.groupBy("form").agg(F.min("value").alias("first"), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("ids")).filter("spellings > 1")
        classes.append(several.select(F.lit(kind).alias("kind"), "first", "spellings", "ids"))
    return reduce(DataFrame.unionByName, classes)


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every value of node.name, node.path and edge.raw that is disguised, with its consistent form."""
    node, edge = table(spark, d, "node"), table(spark, d, "edge")
    values = node.select(F.col("name").alias("value")).union(node.select("path")).union(edge.select(link_part(F.col("raw"))))
    return consistent_forms(values).filter("value <> form")


def _counts(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    tags = table(spark, d, "tag").filter("tag IS NOT NULL")
    counts = term_counts(tags.select(F.col("path").alias("record"), tag_form(F.col("tag")).alias("term"), F.col("tag").alias("raw"), F.col("seen_at").alias("at")))
    return counts, tags.agg(F.count_distinct("path").alias("n")).first()["n"]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return marks(*_counts(spark, d)).filter("mark IS NOT NULL").select(F.col("term").alias("tag"), "mark")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return marks(*_counts(spark, d)).select(F.col("term").alias("tag"), "n_rows", F.col("n_records").alias("n_notes"), "mark")


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_values, p5_found, p5_classes, p5_forms, p6_found, p6_counts)}

_TAG = "trim(regexp_replace(trim(tag), '^#', ''))"
_PAIRS = f"""
WITH t AS (SELECT DISTINCT path, lower({_TAG}) AS tag FROM tag WHERE tag IS NOT NULL AND path IS NOT NULL),
total AS (SELECT count(DISTINCT path)::DOUBLE AS big FROM t),
single AS (SELECT tag, count(*) AS c FROM t GROUP BY tag),
pair AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n FROM t a JOIN t b ON a.path = b.path AND a.tag < b.tag GROUP BY ALL),
full_pair AS (SELECT tag_a, tag_b, n, x.c AS n_a, y.c AS n_b, big FROM pair JOIN single x ON x.tag = tag_a JOIN single y ON y.tag = tag_b, total)"""
_LETTERS = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')"
_SLIPS = f"""
WITH names AS (SELECT DISTINCT entry, {_LETTERS.format('name')} AS f FROM (SELECT type_name AS entry, unnest(list_append(also, type_name)) AS name FROM note_type)),
sized AS (SELECT entry, f, CASE WHEN length(f) < 4 THEN 0 WHEN length(f) < 7 THEN 1 ELSE 2 END AS k FROM names WHERE f <> ''),
vals AS (SELECT DISTINCT type AS value, {_LETTERS.format('type')} AS v FROM node WHERE trim(type) <> '' AND type NOT IN (SELECT type_name FROM note_type)),
hits AS (SELECT value, entry, damerau_levenshtein(v, f) AS slips FROM vals JOIN sized ON abs(length(v) - length(f)) <= k AND damerau_levenshtein(v, f) <= k),
best AS (SELECT v.value, coalesce(arg_min(entry, slips), '?') AS type_name, CAST(min(slips) AS INTEGER) AS slips FROM vals v LEFT JOIN hits h ON h.value = v.value GROUP BY v.value)"""
_COUNTS = f"""
WITH t AS (SELECT DISTINCT path, tag AS raw, lower({_TAG}) AS tag, seen_at FROM tag WHERE tag IS NOT NULL),
c AS (SELECT tag, count(*) AS n_rows, count(DISTINCT path) AS n_notes FROM t GROUP BY tag),
m AS (SELECT *, CASE WHEN n_notes < 3 THEN 'rare' WHEN n_notes > 0.04 * (SELECT count(DISTINCT path) FROM t) THEN 'common' END AS mark FROM c)"""
_SPELLINGS = f"""
WITH names AS (SELECT DISTINCT node_id AS id, name AS v, {sql_looks('name')} AS f FROM node WHERE name IS NOT NULL),
paths AS (SELECT DISTINCT node_id AS id, path AS v, {sql_looks('path')} AS f FROM node WHERE path IS NOT NULL),
stems AS (SELECT id, regexp_replace(v, '\\.md$', '') AS v, regexp_replace(f, '\\.md$', '') AS f FROM paths),
links AS (SELECT DISTINCT edge_id AS id, v, {sql_looks('v')} AS f FROM (SELECT edge_id, {sql_link('raw')} AS v FROM edge WHERE raw IS NOT NULL))"""
_TERM = "CASE WHEN {0} > 0 THEN {0} * ln({0} / ({1})) ELSE 0 END"
_N = "big"
SQL = {
    "p1_found": f"{_PAIRS} SELECT tag_a, tag_b FROM full_pair WHERE n >= 5 AND n >= 0.001 * big AND n * big >= 4 * n_a * n_b",
    "p1_pairs": f"""{_PAIRS}, scored AS (SELECT *, 2 * ({_TERM.format('n', 'n_a * n_b / big')} + {_TERM.format('(n_a - n)', 'n_a * (big - n_b) / big')}
 + {_TERM.format('(n_b - n)', '(big - n_a) * n_b / big')} + {_TERM.format('(big - n_a - n_b + n)', '(big - n_a) * (big - n_b) / big')}) AS score FROM full_pair)
SELECT tag_a, tag_b, n, n_a, n_b, round(n * big / (n_a * n_b), 6) AS lift, round(score, 4) AS llr, score >= 3.84 AS significant FROM scored""",
    "p2_found": f"{_SLIPS} SELECT DISTINCT node_id, type_name FROM node JOIN best ON type = value",
    "p2_values": f"{_SLIPS} SELECT value, type_name, slips FROM best",
    "p5_found": f"""{_SPELLINGS}, found AS (
  SELECT a.id AS a, b.id AS b FROM names a JOIN names b ON a.f = b.f AND a.v <> b.v AND a.id <> b.id UNION SELECT a.id, b.id FROM paths a JOIN paths b ON a.f = b.f AND a.v <> b.v AND a.id <> b.id
  UNION SELECT n.id, l.id FROM names n JOIN links l ON n.f = l.f AND n.v <> l.v AND NOT contains(l.v, '/') UNION SELECT n.id, l.id FROM stems n JOIN links l ON n.f = l.f AND n.v <> l.v AND contains(l.v, '/'))
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM found""",
    "p5_classes": f"""{_SPELLINGS}, every AS (SELECT 'name' AS kind, * FROM names UNION ALL SELECT 'path', * FROM paths UNION ALL SELECT 'link', * FROM links)
SELECT kind, min(v) AS first, count(DISTINCT v) AS spellings, count(*) AS ids FROM every GROUP BY kind, f HAVING count(DISTINCT v) > 1""",
    "p6_found": f"{_COUNTS} SELECT tag, mark FROM m WHERE mark IS NOT NULL",
    "p6_counts": f"{_COUNTS} SELECT tag, n_rows, n_notes, mark FROM m",
}
