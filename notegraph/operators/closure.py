"""Transitive closures by frontier: from one note, or of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.session import cut

LIMIT = 10
#: Notes that are broadcast at most; a path has some hundred bytes.
BROADCAST_NOTES = 100_000


def reach(edges: DataFrame, start: str, limit: int = LIMIT) -> DataFrame:
    """path, depth of all notes reached from `start` (itself left out) in at most `limit` steps.

    edges: src, dst. The depth is the smallest; a note is expanded once, so loops end. Each round
    joins only the frontier with the edges and cuts lineage; a frontier and the notes seen so far
    are broadcast while they are at most BROADCAST_NOTES, so the edges are not shuffled for a few.
    """
    spark = edges.sparkSession
    pairs = cut(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst"))
    seen, n = spark.createDataFrame([(start, 0)], "path string, depth int"), 1
    frontier, new = seen, 1
    for depth in range(1, limit + 1):
        few = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_NOTES else df
        met = pairs.join(few(frontier.select(F.col("path").alias("src")), new), "src", "left_semi").select(F.col("dst").alias("path")).distinct()
        frontier = cut(met.join(few(seen.select("path"), n), "path", "left_anti").withColumn("depth", F.lit(depth)))
        new = frontier.count()
        if not new:
            break
        seen, n = seen.unionByName(frontier), n + new
    return seen.filter(F.col("path") != start)


def all_pairs(edges: DataFrame) -> DataFrame:
    """src, dst for every path of one or more edges: semi-naive, until a round adds nothing.

    The result may be far larger than the input; that is the nature of a materialised closure.
    """
    base = cut(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    known, new = base, base
    while not new.isEmpty():
        step = new.select("src", F.col("dst").alias("via")).join(base.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        new = cut(step.join(known, ["src", "dst"], "left_anti"))
        known = known.unionByName(new)
    return known
