"""Queries over the texts of a vault."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm.mixing import mix
from notegraph.llm.packing import fill_containers, fill_report
from notegraph.llm.shared_spans import expand_pairs, shared_chars, shared_classes, shared_spans
from notegraph.llm.tokens import token_count
from notegraph.session import cut
from notegraph.sources.tables import dealt, table

#: Tokens of a container.
CAPACITY = 4096


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = dealt(table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id")
    return cut(docs.select("doc_id", "source", token_count(F.col("text")).alias("size")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of each document (or piece of one that alone exceeds a container)."""
    sizes = _sizes(spark, d).select(F.col("doc_id").alias("id"), "size")
    return fill_containers(sizes, CAPACITY).withColumnsRenamed({"id": "doc_id", "size": "tokens"})


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, against the least number any packing needs."""
    return fill_report(p7_containers(spark, d).withColumnRenamed("tokens", "size"), CAPACITY)


def p7_rules(spark: SparkSession, d: str) -> DataFrame:
    """rule, n: how many documents are packed, and how often each rule of packing is broken (never)."""
    sizes = _sizes(spark, d).select(F.col("doc_id").alias("id"), "size")
    packed = cut(fill_containers(sizes, CAPACITY))
    fills = packed.groupBy("container").agg(F.sum("size").alias("n"))
    docs = packed.groupBy("id").agg(F.sum("size").alias("packed"), F.count(F.lit(1)).alias("pieces"))
    both = cut(sizes.join(docs, "id", "full").select("size", "packed", "pieces"))
    needed = F.greatest(F.ceil(F.col("size") / CAPACITY), F.lit(1))
    count = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"))
    broken = [
        count(both.filter("packed = size"), "packed whole"),
        count(fills.filter(F.col("n") > CAPACITY), "over capacity"),
        count(both.filter("packed IS NULL OR size IS NULL OR packed <> size"), "missing, foreign or of another size"),
        count(both.filter(F.col("pieces") > needed), "split though it fits"),
        count(packed.groupBy("id", "piece").count().filter("count > 1"), "packed twice"),
    ]
    return reduce(DataFrame.unionByName, broken)


def p8_mix(spark: SparkSession, d: str, size: int | None = None) -> DataFrame:
    """The selected documents, interleaved by slot; size: tokens of the selection."""
    return mix(_sizes(spark, d), table(spark, d, "mix_target"), size)[0].withColumnsRenamed({"size": "tokens", "at": "offset"})


def p8_shares(spark: SparkSession, d: str, size: int | None = None) -> DataFrame:
    """Of each source of the target list, the share it should have and really has."""
    return mix(_sizes(spark, d), table(spark, d, "mix_target"), size)[1].withColumnRenamed("size", "tokens")


def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    """rule, n: how many sources are listed, and how often each rule of mixing is broken (never)."""
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_target")
    selection, shares = mix(sizes, targets)
    selection = cut(selection)
    uses = selection.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("uses")).join(targets, "source", "left")
    largest = sizes.groupBy("source").agg(F.max("size").alias("largest"))
    missed = cut(shares.join(largest, "source", "left").select("source", "target", "short", F.coalesce("largest", F.lit(0)).alias("largest")))
    count = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"))
    broken = [
        count(missed, "listed sources"),
        count(uses.filter("uses > coalesce(max_repeat, 0)"), "used more than max_repeat times or not listed"),
        count(selection.groupBy("doc_id", "pass").count().filter("count > 1"), "used twice in one pass"),
        count(selection.alias("s").join(sizes.alias("d"), "doc_id", "left").filter("d.size IS NULL OR d.size <> s.size OR d.source <> s.source"), "foreign or of another size"),
        count(missed.filter("abs(short) > largest"), "off its target by more than a document"),
    ]
    return reduce(DataFrame.unionByName, broken)


def _all_tokens(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The mix when as many tokens are asked for as the listed sources have."""
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_target")
    listed = sizes.join(targets.select("source"), "source", "left_semi")
    size = listed.agg(F.sum("size").alias("n")).first()["n"] or 0
    return mix(sizes, targets, size=size)


def p8_all_mix(spark: SparkSession, d: str) -> DataFrame:
    """The selected documents when all tokens are asked for: small sources are repeated as often as they may be."""
    return _all_tokens(spark, d)[0].withColumnsRenamed({"size": "tokens", "at": "offset"})


def p8_all_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Shares when as many tokens are asked for as the listed sources have: small ones fall short."""
    return _all_tokens(spark, d)[1].withColumnRenamed("size", "tokens")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with a verbatim stretch of at least 200 characters in common."""
    copies, pairs, _ = shared_spans(table(spark, d, "documents").select("doc_id", "text"))
    return expand_pairs(copies, pairs).withColumnsRenamed({"a": "doc_a", "b": "doc_b"})


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    """Of each document, how many characters stand in stretches that it shares with others."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    copies, _, intervals = shared_spans(docs)
    return shared_chars(docs, copies, intervals)


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Of each document the class of the very same text, and how many others it shares a stretch with."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    copies, pairs, _ = shared_spans(docs)
    return shared_classes(docs, copies, pairs)


QUERIES = {f.__name__: f for f in (p7_containers, p7_report, p7_rules, p8_mix, p8_shares, p8_rules, p8_all_mix, p8_all_tokens, p9_found, p9_shared, p9_classes)}

#: Every window of 200 characters by its md5: brute force, which small tables allow.
_WINDOWS = """
WITH places AS (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200),
windows AS (SELECT doc_id, i, md5(substring(text, i, 200)) AS h FROM places),
shared AS (SELECT h FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, i, h FROM windows SEMI JOIN shared USING (h))"""
SQL = {
    "p7_rules": """SELECT 'packed whole' AS rule, count(*) AS n FROM documents UNION ALL SELECT unnest(['over capacity', 'missing, foreign or of another size', 'split though it fits', 'packed twice']), 0""",
    "p8_rules": """SELECT 'listed sources' AS rule, count(DISTINCT source) AS n FROM mix_target
UNION ALL SELECT unnest(['used more than max_repeat times or not listed', 'used twice in one pass', 'foreign or of another size', 'off its target by more than a document']), 0""",
    "p9_found": f"{_WINDOWS}, k AS (SELECT DISTINCT doc_id, h FROM hits) SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p9_classes": f"""{_WINDOWS}, k AS (SELECT DISTINCT doc_id, h FROM hits), l AS (SELECT a.doc_id, count(DISTINCT b.doc_id) AS n FROM k a JOIN k b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id),
same AS (SELECT text, min(doc_id) AS rep FROM documents WHERE length(text) >= 200 GROUP BY text)
SELECT d.doc_id, coalesce(rep, d.doc_id) AS class_id, coalesce(n, 0) AS links FROM documents d LEFT JOIN same s ON s.text = d.text LEFT JOIN l ON l.doc_id = d.doc_id""",
    "p9_shared": f"""{_WINDOWS}, steps AS (SELECT doc_id, least(200, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 200)) AS n FROM hits),
sums AS (SELECT doc_id, sum(n) AS n FROM steps GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(length(text), 0) AS INTEGER) AS n_chars, CAST(coalesce(n, 0) AS BIGINT) AS shared FROM documents d LEFT JOIN sums s ON s.doc_id = d.doc_id""",
}
