"""Queries of the integrity operators: orphan references and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.operators.hierarchy import descendants, hierarchy, loop_nodes, nested_sets, part_of, subtree_sizes, surplus_parents
from notegraph.operators.references import broken_edges, orphan_report
from notegraph.session import cut
from notegraph.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_edges(table(spark, d, "edge"), table(spark, d, "node")).select("edge_id", "field")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    node = table(spark, d, "node")
    return orphan_report(broken_edges(table(spark, d, "edge"), node), node)


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """The references by path alone, which SQL can express."""
    node = table(spark, d, "node")
    return orphan_report(broken_edges(table(spark, d, "edge"), node).filter("field <> 'raw'"), node)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Notes on a loop of part_of links, through whichever of their parents."""
    return loop_nodes(part_of(table(spark, d, "edge"))).withColumnRenamed("id", "path")


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "node").select(F.col("path").alias("id"))
    return hierarchy(part_of(table(spark, d, "edge")), notes).select("path", "parent", "root", "depth", F.array_join("chain", " > ").alias("chain"), "below", "loop_head")


def p4_surplus(spark: SparkSession, d: str) -> DataFrame:
    """The part_of links that the tree leaves out, as their notes have another parent, too."""
    return surplus_parents(part_of(table(spark, d, "edge"))).withColumnRenamed("child", "path")


def p4_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The nested sets, and for each note how many notes lie in its range and what sets their parents' ranges apart.

    Any order of siblings is right, so the SQL compares what the ranges must imply: below notes in
    the range, the note's place inside that of its parent, and no overlap with a sibling.
    """
    done, _ = subtree_sizes(part_of(table(spark, d, "edge")))
    sets = cut(nested_sets(done))
    up = sets.select(F.col("id").alias("parent"), F.col("lft").alias("u_lft"), F.col("rgt").alias("u_rgt"))
    kids = sets.filter("parent IS NOT NULL").groupBy("parent").agg(
        F.sum(F.col("rgt") - F.col("lft") + 1).alias("filled"), (F.max("rgt") - F.min("lft") + 1).alias("spanned"), F.count_distinct("lft").alias("kids")
    ).withColumnRenamed("parent", "id")
    nested = (F.col("lft") > F.col("u_lft")) & (F.col("rgt") <= F.col("u_rgt"))
    return sets.join(up, "parent", "left").join(kids, "id", "left").select(
        F.col("id").alias("path"), "parent", "root", "depth", "below", (F.col("rgt") - F.col("lft")).alias("width"), F.coalesce(nested, F.lit(True)).alias("in_parent"),
        F.coalesce(F.col("filled") == F.col("spanned"), F.lit(True)).alias("kids_adjoin"), F.coalesce("kids", F.lit(0)).alias("kids"),
    )


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    done, _ = subtree_sizes(part_of(table(spark, d, "edge")))
    return descendants(nested_sets(done)).withColumnRenamed("id", "path")


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p3_paths, p4_found, p4_hierarchy, p4_surplus, p4_ranges, p4_descendants)}

_STATES = """
states AS (SELECT path, bool_or(removed_at IS NULL) AS alive, min(seen_at) AS since FROM node WHERE path IS NOT NULL GROUP BY path),
refs AS (
  SELECT DISTINCT edge_id, 'src' AS field, src AS k, seen_at FROM edge WHERE src IS NOT NULL
  UNION SELECT DISTINCT edge_id, 'dst', dst, seen_at FROM edge WHERE dst IS NOT NULL)"""
_TREE = """
links AS (SELECT DISTINCT src AS child, dst AS parent FROM edge WHERE kind = 'part_of' AND dst IS NOT NULL AND src IS NOT NULL),
tree AS (SELECT child, min(parent) AS parent FROM links GROUP BY child),
walk(id, up) AS (SELECT child, parent FROM tree UNION SELECT w.id, t.parent FROM walk w JOIN tree t ON w.up = t.child),
walk_all(id, up) AS (SELECT child, parent FROM links UNION SELECT w.id, t.parent FROM walk_all w JOIN links t ON w.up = t.child),
heads AS (SELECT w.id, min(w.up) AS loop_head FROM walk_all w JOIN walk_all back ON back.id = w.up AND back.up = w.id GROUP BY w.id)"""

#: Look-alike letters and the Latin ones they read like; independent of the table that looks.py derives.
_ALIKE = ("АВЕКМНОРСТУХЅІЈЁЇаеорсухѕіјһԁԛԝёїΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοսօɡ", "ABEKMHOPCTYXSIJËÏaeopcyxsijhdqwëïABEZHIKMNOPTYXvouog")
_WIDE = ("".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)))


def sql_looks(x: str) -> str:
    """SQL for what a text shows: the steps of looks.py for the characters of the test tables."""
    shown = f"translate(translate({x}, '{_WIDE[0]}', '{_WIDE[1].replace(chr(39), chr(39) * 2)}'), '{_ALIKE[0]}', '{_ALIKE[1]}')"
    for pattern, to in (("[\u00ad\u200b-\u200d\u2060\ufeff]", ""), ("[\u00a0\u2000-\u200a\u202f\u205f\u3000]", " "), ("[\u2010-\u2013\u2212]", "-")):
        shown = f"regexp_replace({shown}, '{pattern}', '{to}', 'g')"
    for joined, to in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        shown = f"replace({shown}, '{joined}', '{to}')"
    return f"trim(nfc_normalize({shown}))"


def sql_link(x: str) -> str:
    """SQL for the part of a link before its first alias, heading or block mark."""
    return f"trim(regexp_extract({x}, '^((?s:.*?))(?:\\\\\\||\\||#|\\^|$)', 1))"


_STEM = "regexp_replace(path, '\\.md$', '')"


def _ends(states: str) -> str:
    """SQL rows (k, since) of the looks by which a link finds one of `states`: name, path without .md, ends of that."""
    parts = f"SELECT string_split({sql_looks(_STEM)}, '/') AS p, since FROM {states}"
    return f"SELECT {sql_looks('name')} AS k, since FROM {states} WHERE name IS NOT NULL UNION ALL SELECT array_to_string(p[i:], '/'), since FROM (SELECT p, since, unnest(range(1, len(p) + 1)) AS i FROM ({parts}))"


_BROKEN = f"""
notes AS (SELECT path, max(name) AS name, bool_or(removed_at IS NULL) AS alive, min(seen_at) AS since FROM node WHERE path IS NOT NULL GROUP BY path),
there AS (SELECT * FROM notes WHERE alive),
path_refs AS (
  SELECT DISTINCT edge_id, 'src' AS field, src AS k, seen_at FROM edge WHERE src IS NOT NULL
  UNION SELECT DISTINCT edge_id, 'dst', dst, seen_at FROM edge WHERE dst IS NOT NULL),
link_refs AS (SELECT DISTINCT edge_id, 'raw' AS field, {sql_looks(sql_link('raw'))} AS k, seen_at FROM edge WHERE dst IS NULL AND raw IS NOT NULL),
there_ends AS (SELECT k, min(since) AS since FROM ({_ends('there')}) GROUP BY k),
all_ends AS (SELECT DISTINCT k FROM ({_ends('notes')})),
broken AS (
  SELECT edge_id, field, k, seen_at, since FROM path_refs LEFT JOIN there ON k = path WHERE path IS NULL OR since > seen_at
  UNION ALL SELECT edge_id, field, l.k, seen_at, since FROM link_refs l LEFT JOIN there_ends e ON l.k = e.k WHERE e.k IS NULL OR since > seen_at)"""

SQL = {
    "p3_found": f"WITH {_BROKEN} SELECT edge_id, field FROM broken",
    "p3_report": f"""WITH {_BROKEN}
SELECT 'edge' AS "table", field, strftime(seen_at, '%Y-%m') AS month,
       CASE WHEN b.since IS NOT NULL THEN 'late' WHEN (field = 'raw' AND a.k IS NOT NULL) OR (field <> 'raw' AND n.path IS NOT NULL) THEN 'deleted' ELSE 'missing' END AS reason, count(*) AS n
FROM broken b LEFT JOIN notes n ON n.path = b.k LEFT JOIN all_ends a ON a.k = b.k GROUP BY ALL""",
    "p3_paths": f"""
WITH {_STATES}
SELECT 'edge' AS "table", field, strftime(seen_at, '%Y-%m') AS month,
       CASE WHEN alive THEN 'late' WHEN NOT alive THEN 'deleted' ELSE 'missing' END AS reason, count(*) AS n
FROM refs LEFT JOIN states ON k = path
WHERE path IS NULL OR NOT alive OR since > seen_at
GROUP BY ALL""",
    "p4_found": f"WITH RECURSIVE {_TREE} SELECT id AS path, loop_head FROM heads",
    "p4_surplus": f"WITH RECURSIVE {_TREE} SELECT l.child AS path, l.parent, t.parent AS chosen FROM links l JOIN tree t ON t.child = l.child WHERE l.parent <> t.parent",
    "p4_ranges": f"""
WITH RECURSIVE {_TREE},
ids AS (SELECT child AS id FROM tree UNION SELECT parent FROM tree),
on_loop AS (SELECT id FROM walk WHERE id = up),
loose AS (SELECT id FROM on_loop UNION SELECT id FROM walk WHERE up IN (SELECT id FROM on_loop)),
ups AS (SELECT id, up FROM walk WHERE id NOT IN (SELECT id FROM loose)),
depth AS (SELECT ids.id, count(up) AS depth FROM ids LEFT JOIN ups ON ups.id = ids.id GROUP BY ids.id),
root AS (SELECT u.id, u.up AS root FROM ups u WHERE u.up NOT IN (SELECT child FROM tree)),
below AS (SELECT up AS id, count(*) AS below FROM ups GROUP BY up),
kids AS (SELECT parent AS id, count(*) AS kids FROM tree GROUP BY parent)
SELECT ids.id AS path, t.parent, coalesce(r.root, ids.id) AS root, CAST(d.depth AS INTEGER) AS depth, coalesce(b.below, 0) AS below, coalesce(b.below, 0) AS width,
       true AS in_parent, true AS kids_adjoin, coalesce(k.kids, 0) AS kids
FROM ids JOIN depth d ON d.id = ids.id LEFT JOIN tree t ON t.child = ids.id LEFT JOIN root r ON r.id = ids.id LEFT JOIN below b ON b.id = ids.id LEFT JOIN kids k ON k.id = ids.id
WHERE ids.id NOT IN (SELECT id FROM loose)""",
    "p4_descendants": f"""
WITH RECURSIVE {_TREE},
on_loop AS (SELECT id FROM walk WHERE id = up),
loose AS (SELECT id FROM on_loop UNION SELECT id FROM walk WHERE up IN (SELECT id FROM on_loop)),
ups AS (SELECT id, up FROM walk WHERE id NOT IN (SELECT id FROM loose)),
depth AS (SELECT id, count(*) AS depth FROM ups GROUP BY id)
SELECT up AS ancestor, u.id AS path, CAST(d.depth - coalesce(a.depth, 0) AS INTEGER) AS steps
FROM ups u JOIN depth d ON d.id = u.id LEFT JOIN depth a ON a.id = u.up""",
    "p4_hierarchy": f"""
WITH RECURSIVE {_TREE},
on_loop AS (SELECT id FROM walk WHERE id = up),
loose AS (SELECT id FROM on_loop UNION SELECT id FROM walk WHERE up IN (SELECT id FROM on_loop)),
ids AS (SELECT path AS id FROM node WHERE path IS NOT NULL UNION SELECT child FROM tree UNION SELECT parent FROM tree),
ups AS (SELECT id, up FROM walk WHERE id NOT IN (SELECT id FROM loose)),
depth AS (SELECT ids.id, count(up) AS depth FROM ids LEFT JOIN ups ON ups.id = ids.id GROUP BY ids.id),
chains AS (SELECT u.id, string_agg(u.up, ' > ' ORDER BY d.depth) AS c, arg_min(u.up, d.depth) AS root FROM ups u JOIN depth d ON d.id = u.up GROUP BY u.id),
below AS (SELECT up AS id, count(*) AS below FROM ups GROUP BY up)
SELECT ids.id AS path, t.parent, CASE WHEN l.id IS NULL THEN coalesce(c.root, ids.id) END AS root,
       CASE WHEN l.id IS NULL THEN CAST(d.depth AS INTEGER) END AS depth,
       CASE WHEN l.id IS NULL THEN coalesce(c.c || ' > ', '') || ids.id END AS chain,
       CASE WHEN l.id IS NULL THEN coalesce(b.below, 0) END AS below, h.loop_head
FROM ids LEFT JOIN tree t ON t.child = ids.id LEFT JOIN loose l ON l.id = ids.id LEFT JOIN depth d ON d.id = ids.id
LEFT JOIN chains c ON c.id = ids.id LEFT JOIN below b ON b.id = ids.id LEFT JOIN heads h ON h.id = ids.id""",
}
