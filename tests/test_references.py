from datetime import datetime

from pyspark.sql import functions as F

from notegraph.functions import bloom

from notegraph.operators.references import broken_edges, orphan_references, orphan_report

NODE = "node_id bigint, path string, name string, seen_at timestamp_ntz, removed_at timestamp_ntz, kind string"
EDGE = "edge_id bigint, src string, dst string, raw string, kind string, seen_at timestamp_ntz"
t = lambda d: datetime(2024, 1, d)


def vault(spark):
    node = spark.createDataFrame(
        [
            (1, "z/A.md", "A", t(1), None, "x"), (1, "z/A.md", "A", t(5), t(6), "x"),  # deleted once, but there
            (2, "z/B.md", "B", t(1), t(2), "x"),  # deleted
            (3, "y/d/C.md", "C", t(10), None, "x"),  # later
            (4, "y/Кey.md", "Кey", t(1), None, "x"), (None, None, None, None, None, None),
        ],
        NODE,
    )
    edge = spark.createDataFrame(
        [
            (11, "z/A.md", "z/B.md", "B", "k", t(3)), (11, "z/A.md", "z/B.md", "B", "k", t(3)),
            (12, "z/A.md", "y/d/C.md", "C", "k", t(3)), (13, "z/A.md", "y/d/C.md", "C", "k", t(10)),
            (14, "gone.md", None, "Key|x", "k", t(3)), (15, "z/A.md", None, "d/C#h", "k", t(3)), (16, "z/A.md", None, "d/C#h", "k", t(12)),
            (17, "z/A.md", None, "nowhere", "k", t(3)), (18, "z/A.md", None, "#x", "k", t(3)), (19, None, None, "A", "k", None),
        ],
        EDGE,
    )
    return node, edge


def test_broken_edges(spark):
    node, edge = vault(spark)
    got = {(r["edge_id"], r["field"]) for r in broken_edges(edge, node).collect()}
    assert got == {(11, "dst"), (12, "dst"), (14, "src"), (15, "raw"), (17, "raw"), (18, "raw")}


def test_report(spark):
    node, edge = vault(spark)
    got = {(r["field"], r["month"], r["reason"], r["n"]) for r in orphan_report(broken_edges(edge, node), node).collect()}
    assert got == {("dst", "2024-01", "deleted", 1), ("dst", "2024-01", "late", 1), ("src", "2024-01", "missing", 1), ("raw", "2024-01", "late", 1), ("raw", "2024-01", "missing", 2)}


def test_empty_tables(spark):
    node, edge = vault(spark)
    assert broken_edges(edge.limit(0), node).count() == 0
    assert {r["edge_id"] for r in broken_edges(edge, node.limit(0)).filter("field = 'src'").collect()} == {11, 12, 13, 14, 15, 16, 17, 18}


def test_hot_and_many_keys(spark):
    refs = spark.range(5000).selectExpr("id AS ref_id", "'f' AS field", "if(id % 3 = 0, 'hot', concat('k', id)) AS key", "timestamp_ntz'2024-01-02' AS at")
    parents = spark.range(0, 5000, 2).selectExpr("concat('k', id) AS key", "if(id % 10 = 0, timestamp_ntz'2024-02-01', timestamp_ntz'2024-01-01') AS since")
    got = {r["ref_id"] for r in orphan_references(refs, parents).collect()}
    assert got == {i for i in range(5000) if i % 3 == 0 or i % 2 or i % 10 == 0}


def test_report_tells_deleted_links_by_looks(spark):
    node, _ = vault(spark)
    rows = [(21, "z/A.md", None, "z/B", "k", t(3)), (22, "z/A.md", None, "B#h", "k", t(3)), (23, "z/A.md", None, "nowhere", "k", t(3)), (24, "z/A.md", None, "C", "k", t(3)), (25, "z/A.md", None, "A", "k", t(3))]
    edge = spark.createDataFrame(rows, EDGE)
    orphans = broken_edges(edge, node)
    counts = {r["reason"]: r["n"] for r in orphan_report(orphans, node).filter("field = 'raw'").collect()}
    assert counts == {"deleted": 2, "missing": 1, "late": 1}


def test_filters_keep_proving_orphans_as_keys_grow(spark, monkeypatch):
    """100 million parents with filters of 8 MB, both scaled by 64: under 2 % of the orphans stay unproven."""
    monkeypatch.setattr(bloom, "MAX_BITS", bloom.MAX_BITS // 64)
    n = 100_000_000 // 64
    parents = spark.range(n).selectExpr("concat('p', id) AS key")
    filters = bloom.bloom_of(parents, F.col("key"), n)
    assert len(filters.filters) == 18
    orphans = spark.range(200_000).selectExpr("concat('o', id) AS key")
    unproven = orphans.filter(bloom.might_contain(orphans, filters, F.col("key"))).count()
    assert unproven < 0.02 * 200_000
    some = parents.limit(100_000)
    assert some.filter(~bloom.might_contain(some, filters, F.col("key"))).count() == 0


def test_more_keys_than_the_filters_take(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MAX_BITS", 1024)
    monkeypatch.setattr(bloom, "MAX_FILTERS", 3)
    node, edge = vault(spark)
    for n in (100, 250, 300):  # one filter, several, none
        parents = spark.range(n).selectExpr("concat('p', id) AS key", "timestamp_ntz'2024-01-05 00:00:00' AS since")
        refs = spark.range(2 * n).selectExpr("id AS ref_id", "'f' AS field", "concat('p', id) AS key", "timestamp_ntz'2024-01-06 00:00:00' AS at", "id AS since")
        late = refs.limit(1).selectExpr("-1L AS ref_id", "'f' AS field", "'p7' AS key", "timestamp_ntz'2024-01-04 00:00:00' AS at", "0L AS since")
        got = {r["ref_id"] for r in orphan_references(refs.unionByName(late), parents).collect()}
        assert got == {-1, *range(n, 2 * n)}
        assert orphan_references(refs, parents.limit(0)).count() == 2 * n and orphan_references(refs.limit(0), parents).count() == 0
