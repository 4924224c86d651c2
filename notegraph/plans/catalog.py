"""The query catalogue over a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions.text import nfc
from notegraph.operators.closure import LIMIT, reach
from notegraph.plans.build import Graph
from notegraph.sources.tables import table


def stats(g: Graph) -> DataFrame:
    """section, key, n: rows of each table, unresolved edges, edges by kind."""
    kinds = g.edge.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dst").isNull()).alias("loose"))
    rows = F.array(F.struct(F.lit("edge").alias("key"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")), F.struct(F.lit("unresolved").alias("key"), F.coalesce(F.sum("loose"), F.lit(0)).alias("n")))
    edges = kinds.agg(rows.alias("r")).select(F.lit("total").alias("section"), F.explode("r").alias("r")).select("section", "r.key", "r.n")
    total = lambda df, key: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("section"), F.lit(key).alias("key"), "n")
    return total(g.node, "node").unionByName(edges).unionByName(total(g.tag, "tag")).unionByName(kinds.select(F.lit("kind").alias("section"), F.col("kind").alias("key"), "n"))


def by_type(g: Graph, type_: str) -> DataFrame:
    """Paths of a type, sorted."""
    return g.node.filter(F.col("type") == type_).select("path").orderBy("path")


def by_tag(g: Graph, tag: str) -> DataFrame:
    """Paths with the tag or one nested below it, sorted."""
    return g.tag.filter((F.col("tag") == tag) | F.col("tag").startswith(tag + "/")).select("path").distinct().orderBy("path")


def learning_path(g: Graph, path: str, limit: int = LIMIT) -> DataFrame:
    """path, depth of what a note builds on, directly or not, nearest first."""
    return reach(g.edge.filter("kind = 'builds_on'").select("src", "dst"), path, limit).orderBy("depth", "path")


def near(g: Graph, path: str) -> DataFrame:
    """rel, path, n: notes it links to, that link to it, or that share tags and do neither."""
    out = g.edge.filter((F.col("src") == path) & F.col("dst").isNotNull()).select(F.lit("links_to").alias("rel"), F.col("dst").alias("path")).distinct()
    back = g.edge.filter(F.col("dst") == path).select(F.lit("linked_by").alias("rel"), F.col("src").alias("path")).distinct()
    linked = out.unionByName(back)
    mine = g.tag.filter(F.col("path") == path).groupBy("tag").agg(F.count(F.lit(1)).alias("times"))
    shared = g.tag.filter(F.col("path") != path).join(mine, "tag").groupBy("path").agg(F.sum("times").alias("n")).join(linked.select("path").distinct(), "path", "left_anti")
    none = F.lit(None).cast("bigint").alias("n")
    return linked.select("rel", "path", none).unionByName(shared.select(F.lit("shares_tag").alias("rel"), "path", "n")).orderBy("rel", F.desc("n"), "path")


def orphans(g: Graph, zone: str | None = None) -> DataFrame:
    """Paths that no edge leads to, sorted; of one zone if given."""
    node = g.node if zone is None else g.node.filter(F.col("zone") == zone)
    return node.join(g.edge.select(F.col("dst").alias("path")).filter("path IS NOT NULL").distinct(), "path", "left_anti").select("path").orderBy("path")


def find(g: Graph, needle: str) -> DataFrame:
    """The first path, by itself or by its name; no row if there is none."""
    import unicodedata

    want = unicodedata.normalize("NFC", needle)
    return g.node.filter((F.col("path") == want) | (F.col("name") == want)).agg(F.min("path").alias("path")).filter("path IS NOT NULL")


def tag_exact(g: Graph, tag: str) -> DataFrame:
    """path, c: notes with exactly this tag and how often."""
    return g.tag.filter(F.col("tag") == tag).join(g.node.select("path"), "path").groupBy("path").agg(F.count(F.lit(1)).alias("c"))


def near_scored(g: Graph, path: str) -> DataFrame:
    """path, score, why: links and backlinks weigh 3, a shared tag 2."""
    w = lambda df, n, why: df.select("path", F.lit(n).alias("w"), why.alias("why"))
    links = g.edge.filter("kind = 'links_to'")
    mine = g.tag.filter(F.col("path") == path).select("tag")
    parts = (
        w(links.filter((F.col("src") == path) & F.col("dst").isNotNull()).select(F.col("dst").alias("path")), 3, F.lit("link"))
        .unionByName(w(links.filter(F.col("dst") == path).select(F.col("src").alias("path")), 3, F.lit("backlink")))
        .unionByName(w(g.tag.filter(F.col("path") != path).join(mine, "tag"), 2, F.concat(F.lit("tag #"), F.col("tag"))))
    )
    scored = parts.groupBy("path").agg(F.sum("w").alias("score"), F.array_join(F.array_sort(F.collect_set("why")), ",").alias("why"))
    return scored.join(g.node.select("path"), "path").orderBy(F.desc("score"), "path")


def orphans_legacy(g: Graph, start: str | None = None) -> DataFrame:
    """zone, path without an edge from another note; a link to itself doesn't count. start: of zone or path."""
    inbound = g.edge.filter("dst IS NOT NULL AND src <> dst").select(F.col("dst").alias("path")).distinct()
    out = g.node.join(inbound, "path", "left_anti").select("zone", "path")
    if start:
        out = out.filter(F.col("zone").startswith(start) | F.col("path").startswith(start))
    return out.orderBy("zone", "path")


def path_legacy(g: Graph, path: str) -> DataFrame:
    """The note itself at depth 0, and all it builds on however far, with type and summary."""
    start = g.node.filter(F.col("path") == path).select("path", F.lit(0).alias("depth"))
    found = start.unionByName(reach(g.edge.filter("kind = 'builds_on'").select("src", "dst"), path, 1 << 20))
    return found.join(g.node.select("path", "name", "type", F.substring("summary", 1, 70).alias("summary")), "path", "left").orderBy("depth", "path")


def stats_legacy(g: Graph, top: int = 10) -> DataFrame:
    """section, key, n: nodes by zone and type, edges by kind, the most frequent tags."""
    counted = lambda df, section, key: df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "key", "n")
    tags = counted(g.tag, "tag", F.col("tag")).orderBy(F.desc("n"), "key").limit(top)
    return counted(g.node, "zone", F.col("zone")).unionByName(counted(g.node, "type", F.coalesce("type", F.lit("(none)")))).unionByName(counted(g.edge, "kind", F.col("kind"))).unionByName(tags)


def sql(g: Graph, text: str) -> DataFrame:
    """Any SQL over the views node, edge and tag."""
    g.views()
    return g.node.sparkSession.sql(text)


def unresolved_by_target(g: Graph, excluded: DataFrame) -> DataFrame:
    """where, n: unresolved links whose last part is the name of a note in `excluded` (path), or not."""
    from notegraph.functions.text import path_name

    names = excluded.select(path_name(F.col("path")).alias("k")).distinct().withColumn("hit", F.lit(True))
    raws = g.edge.filter("dst IS NULL").groupBy(nfc(F.element_at(F.split("raw", "/"), -1)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return raws.join(names, "k", "left").groupBy(F.when(F.col("hit"), "excluded").otherwise("other").alias("where")).agg(F.sum("n").alias("n"))


def latest(spark: SparkSession, d: str) -> Graph:
    """The graph of the tables: the latest row of each note that is not removed; edges and tags once."""
    node = table(spark, d, "node")
    kept = ["path", "name", "zone", "dir", "type", "summary", "created", "bytes"]
    last = node.groupBy("path").agg(F.max_by(F.struct("removed_at", *kept[1:]), F.struct("seen_at", "loaded_at")).alias("r"))
    now = last.select("path", "r.*").filter("removed_at IS NULL")
    edge = table(spark, d, "edge").select("edge_id", "src", "dst", "raw", "kind").distinct()
    tag = table(spark, d, "tag").filter("tag IS NOT NULL").select("path", "tag").distinct()
    return Graph(now.select(kept), edge.select("src", "dst", "raw", "kind"), tag)


HUB = "000 Landing/Atlas.md"


def _start(g: Graph) -> str:
    """The note that builds on most others, for the queries about one note."""
    top = g.edge.filter("kind = 'builds_on' AND dst IS NOT NULL").groupBy("src").agg(F.count_distinct("dst").alias("n")).orderBy(F.desc("n"), "src").first()
    return top["src"] if top else HUB


def _of(f, *args):
    return lambda spark, d: f(latest(spark, d), *args)


def _at_start(f):
    def run(spark, d):
        g = latest(spark, d)
        return f(g, _start(g))

    return run


QUERIES = {
    "q_stats": _of(stats),
    "q_by_type": _of(by_type, "concept"),
    "q_by_tag": _of(by_tag, "Stack"),
    "q_learning_path": _at_start(learning_path),
    "q_near": _of(near, HUB),
    "q_orphans": _of(orphans),
    "q_orphans_zone": _of(orphans, "300 Reading"),
    "q_find": _of(find, "Atlas"),
    "q_tag_exact": _of(tag_exact, "Status/Draft"),
    "q_near_scored": _of(near_scored, HUB),
    "q_orphans_legacy": _of(orphans_legacy),
    "q_path_legacy": _at_start(path_legacy),
    "q_stats_legacy": _of(stats_legacy),
    "q_sql": _of(sql, "SELECT n.zone, count(DISTINCT e.src) AS sources FROM edge e JOIN node n ON n.path = e.dst GROUP BY n.zone"),
    "q_unresolved": lambda spark, d: unresolved_by_target(latest(spark, d), table(spark, d, "node").filter(F.col("zone").isin("950 Attic"))),
}

_G = """
n0 AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, loaded_at DESC) AS r FROM node),
gn AS (SELECT path, name, zone, dir, type, summary, created, bytes FROM n0 WHERE r = 1 AND removed_at IS NULL),
ge AS (SELECT src, dst, raw, kind FROM (SELECT DISTINCT edge_id, src, dst, raw, kind FROM edge)),
gt AS (SELECT DISTINCT path, tag FROM tag WHERE tag IS NOT NULL)"""
_W = f"WITH {_G}"
_START = "start AS (SELECT src AS s FROM ge WHERE kind = 'builds_on' AND dst IS NOT NULL GROUP BY src ORDER BY count(DISTINCT dst) DESC, src LIMIT 1)"
_CHAIN = f"""WITH RECURSIVE {_G}, {_START},
chain(id, depth) AS (SELECT s, 0 FROM start UNION SELECT e.dst, c.depth + 1 FROM chain c JOIN ge e ON e.src = c.id WHERE e.kind = 'builds_on' AND e.dst IS NOT NULL AND c.depth < {{}})"""
_ORPHAN = "FROM gn WHERE NOT EXISTS (SELECT 1 FROM ge WHERE ge.dst = gn.path"
SQL = {
    "q_stats": f"""{_W} SELECT 'total' AS section, 'node' AS key, count(*) AS n FROM gn UNION ALL SELECT 'total', 'edge', count(*) FROM ge UNION ALL SELECT 'total', 'tag', count(*) FROM gt
UNION ALL SELECT 'total', 'unresolved', count(*) FROM ge WHERE dst IS NULL UNION ALL SELECT 'kind', kind, count(*) FROM ge GROUP BY kind""",
    "q_by_type": f"{_W} SELECT path FROM gn WHERE type = 'concept'",
    "q_by_tag": f"{_W} SELECT DISTINCT path FROM gt WHERE tag = 'Stack' OR starts_with(tag, 'Stack/')",
    "q_learning_path": f"{_CHAIN.format(LIMIT)} SELECT id AS path, CAST(min(depth) AS INTEGER) AS depth FROM chain WHERE id <> (SELECT s FROM start) GROUP BY id",
    "q_near": f"""{_W}, o AS (SELECT DISTINCT dst AS path FROM ge WHERE src = '{HUB}' AND dst IS NOT NULL), b AS (SELECT DISTINCT src AS path FROM ge WHERE dst = '{HUB}')
SELECT 'links_to' AS rel, path, NULL::BIGINT AS n FROM o UNION ALL SELECT 'linked_by', path, NULL FROM b UNION ALL
SELECT 'shares_tag', y.path, count(*) FROM gt x JOIN gt y ON x.tag = y.tag WHERE x.path = '{HUB}' AND y.path <> x.path AND y.path NOT IN (SELECT path FROM o UNION SELECT path FROM b) GROUP BY y.path""",
    "q_orphans": f"{_W} SELECT path {_ORPHAN})",
    "q_orphans_zone": f"{_W} SELECT path {_ORPHAN}) AND zone = '300 Reading'",
    "q_find": f"{_W} SELECT min(path) AS path FROM gn WHERE path = 'Atlas' OR name = 'Atlas' HAVING min(path) IS NOT NULL",
    "q_tag_exact": f"{_W} SELECT path, count(*) AS c FROM gt JOIN gn USING (path) WHERE tag = 'Status/Draft' GROUP BY path",
    "q_near_scored": f"""{_W}, x AS (SELECT dst AS path, 3 AS w, 'link' AS why FROM ge WHERE src = '{HUB}' AND dst IS NOT NULL AND kind = 'links_to'
UNION ALL SELECT src, 3, 'backlink' FROM ge WHERE dst = '{HUB}' AND kind = 'links_to'
UNION ALL SELECT b.path, 2, 'tag #' || a.tag FROM gt a JOIN gt b ON a.tag = b.tag WHERE a.path = '{HUB}' AND b.path <> '{HUB}')
SELECT path, CAST(sum(w) AS BIGINT) AS score, array_to_string(list_sort(list_distinct(list(why))), ',') AS why FROM x JOIN gn USING (path) GROUP BY path""",
    "q_orphans_legacy": f"{_W} SELECT zone, path {_ORPHAN} AND ge.src <> gn.path)",
    "q_path_legacy": f"{_CHAIN.format(1000)} SELECT id AS path, CAST(depth AS INTEGER) AS depth, name, type, substr(summary, 1, 70) AS summary FROM (SELECT id, min(depth) AS depth FROM chain GROUP BY id) LEFT JOIN gn ON gn.path = id WHERE depth > 0 OR gn.path IS NOT NULL",
    "q_stats_legacy": f"""{_W} SELECT 'zone' AS section, zone AS key, count(*) AS n FROM gn GROUP BY zone UNION ALL SELECT 'type', coalesce(type, '(none)'), count(*) FROM gn GROUP BY 2
UNION ALL SELECT 'kind', kind, count(*) FROM ge GROUP BY kind UNION ALL (SELECT 'tag', tag, count(*) AS n FROM gt GROUP BY tag ORDER BY n DESC, tag LIMIT 10)""",
    "q_sql": f"{_W} SELECT n.zone, count(DISTINCT e.src) AS sources FROM ge e JOIN gn n ON n.path = e.dst GROUP BY n.zone",
    "q_unresolved": f"""{_W}, names AS (SELECT DISTINCT regexp_replace(string_split(path, '/')[-1], '\\.md$', '') AS k FROM node WHERE zone = '950 Attic')
SELECT CASE WHEN k IS NULL THEN 'other' ELSE 'excluded' END AS "where", count(*) AS n FROM ge LEFT JOIN names ON k = nfc_normalize(string_split(raw, '/')[-1]) WHERE dst IS NULL GROUP BY 1""",
}
