"""What got lost between two snapshots of a vault."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegraph.sources.tables import table

SHRINK_RATIO = 0.5
SHRINK_MIN_LINES = 10


def line_count(text: F.Column) -> F.Column:
    """Lines as str.splitlines counts them for \\n, \\r\\n and \\r: a last line end opens no new line."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    n = F.size(F.split(t, "\n"))
    return F.when(t == "", 0).when(t.endswith("\n"), n - 1).otherwise(n)


def missing(head: DataFrame, work: DataFrame) -> DataFrame:
    """path of `head` that `work` has no more."""
    return head.select("path").join(work.select("path"), "path", "left_anti")


def shrunk(head: DataFrame, work: DataFrame, ratio: float = SHRINK_RATIO, least: int = SHRINK_MIN_LINES) -> DataFrame:
    """path, old, new of notes (path, lines) with at least `least` lines that lost more than 1 - `ratio` of them."""
    both = head.filter(F.col("path").endswith(".md")).select("path", F.col("lines").alias("old")).join(work.select("path", F.col("lines").alias("new")), "path")
    return both.filter((F.col("old") >= least) & (F.col("new") < F.col("old") * ratio))


def placeholders(files: DataFrame) -> DataFrame:
    """path, real: files that a cloud drive moved away, and the file each stands for."""
    name = F.element_at(F.split("path", "/"), -1)
    real = F.concat(F.regexp_extract("path", r"\A((?s:.*/)?)[^/]*\z", 1), F.regexp_replace(F.regexp_replace(name, r"\A\.", ""), r"\.icloud\z", ""))
    return files.filter(F.col("path").endswith(".icloud")).select("path", real.alias("real"))


def doctor(head: DataFrame, work: DataFrame, files: DataFrame) -> DataFrame:
    """check, path, detail: missing, placeholder and shrunk files; no row means all is well."""
    none = F.lit("")
    m = missing(head, work).select(F.lit("missing").alias("check"), "path", none.alias("detail"))
    p = placeholders(files).select(F.lit("placeholder").alias("check"), "path", F.col("real").alias("detail"))
    s = shrunk(head, work).select(F.lit("shrunk").alias("check"), "path", F.concat_ws(" ", F.col("old").cast("string"), F.lit("->"), F.col("new").cast("string")).alias("detail"))
    return m.unionByName(p).unionByName(s)


def gate(head: DataFrame, staged: DataFrame) -> DataFrame:
    """check, path of what a commit of `staged` would delete or shrink; no row lets it pass."""
    return missing(head, staged).select(F.lit("deleted").alias("check"), "path").unionByName(shrunk(head, staged).select(F.lit("shrunk").alias("check"), "path"))


def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The first and the last scan of each note, with its kilobytes (at least one) as lines."""
    node = table(spark, d, "node")
    order = lambda f: Window.partitionBy("path").orderBy(f("seen_at"), f("loaded_at"))
    lines = F.ceil(F.coalesce("bytes", F.lit(0)) / 100)
    first = node.withColumn("n", F.row_number().over(order(F.asc))).filter("n = 1").select("path", lines.alias("lines"))
    last = node.withColumn("n", F.row_number().over(order(F.desc))).filter("n = 1 AND removed_at IS NULL").select("path", lines.alias("lines"))
    return first, last


def doctor_scans(spark: SparkSession, d: str) -> DataFrame:
    """Loss between the first and the last scan of each note."""
    first, last = _scans(spark, d)
    return doctor(first, last, table(spark, d, "node").select("path").distinct())


def gate_scans(spark: SparkSession, d: str) -> DataFrame:
    return gate(*_scans(spark, d))


QUERIES = {f.__name__: f for f in (doctor_scans, gate_scans)}

_SCANS = """
f AS (SELECT path, CAST(ceil(coalesce(bytes, 0) / 100) AS BIGINT) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen_at, loaded_at) AS n FROM node) WHERE n = 1),
l AS (SELECT path, CAST(ceil(coalesce(bytes, 0) / 100) AS BIGINT) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, loaded_at DESC) AS n FROM node) WHERE n = 1 AND removed_at IS NULL),
gone AS (SELECT path FROM f WHERE path NOT IN (SELECT path FROM l)),
less AS (SELECT path, f.lines AS old, l.lines AS new FROM f JOIN l USING (path) WHERE path LIKE '%.md' AND f.lines >= 10 AND l.lines < f.lines * 0.5)"""
SQL = {
    "doctor_scans": f"""WITH {_SCANS} SELECT 'missing' AS "check", path, '' AS detail FROM gone UNION ALL SELECT 'shrunk', path, old || ' -> ' || new FROM less""",
    "gate_scans": f"""WITH {_SCANS} SELECT 'deleted' AS "check", path FROM gone UNION ALL SELECT 'shrunk', path FROM less""",
}
