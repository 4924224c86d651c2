"""References to records that do not exist, are deleted, or arrive later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.functions.bloom import bloom_of, might_contain
from notegraph.functions.looks import link_part, look_form
from notegraph.operators.skew import heavy_keys, skew_join
from notegraph.session import cut


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of `refs` whose key is that of no parent that is there.

    refs: ref_id, field, key, at. parents: key, since - one row for each key that is there, from
    `since` on. Result: the rows of `refs`, repeats once, with `since` of the parent (null: none).

    Bloom filters of the parent keys (as many as they need, within bloom.MAX_FILTERS) prove most
    orphans. Of the others only the earliest reference of each key, a partial aggregate, is joined
    exactly with the parents. That leaves suspect keys; a second filter picks their references, and
    those are verified by an exact join, from which hot keys are split off. A hot key thus never
    meets in one task, and no reference is shuffled that is not an orphan or a false positive, as
    long as the keys fit the filters; beyond them the same joins take every reference. A null key
    references nothing and is no orphan; a reference without a time is there whenever its parent is.
    Empty tables: no parents make every reference an orphan, no references give no rows.
    """
    refs, parents = refs.select("ref_id", "field", "key", "at").filter(F.col("key").isNotNull()), parents.select("key", "since")
    there = bloom_of(parents, F.col("key"), parents.count())
    maybe = refs.withColumn("_maybe", might_contain(refs, there, F.col("key")))
    sure = maybe.filter(~F.col("_maybe")).drop("_maybe").withColumn("since", F.lit(None).cast("timestamp_ntz"))
    late = lambda at: F.col("since").isNull() | (F.col("since") > F.col(at))
    earliest = maybe.filter("_maybe").groupBy("key").agg(F.min("at").alias("_first"))
    suspects = cut(earliest.join(parents, "key", "left").filter(F.coalesce(late("_first"), F.lit(False))).select("key", "since"))
    n = suspects.count()
    columns = ["ref_id", "field", "key", "at", "since"]
    if not n:
        return sure.select(columns).distinct()
    again = maybe.filter("_maybe").drop("_maybe")
    again = cut(again.filter(might_contain(again, bloom_of(suspects, F.col("key"), n), F.col("key"))))
    met = skew_join(again, suspects, "key", "inner", heavy_keys(again, "key", rows=again.count()))
    verified = met.filter(F.coalesce(late("at"), F.lit(False)))
    return sure.select(columns).unionByName(verified.select(columns)).distinct()


def note_states(node: DataFrame) -> DataFrame:
    """path, name, alive, since: the state of each note over all its scans; null paths are no notes."""
    return (
        node.filter(F.col("path").isNotNull())
        .groupBy("path")
        .agg(F.max("name").alias("name"), F.coalesce(F.max(F.col("removed_at").isNull()), F.lit(False)).alias("alive"), F.min("seen_at").alias("since"))
    )


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md\z", "")


def _look_keys(notes: DataFrame) -> DataFrame:
    """since, key: the forms by which a link finds a note: name, whole path without .md, and ends of such a path."""
    spark = notes.sparkSession
    forms = notes.select("since", look_form(spark, F.col("name")).alias("name"), look_form(spark, _stem(F.col("path"))).alias("stem"))
    parts = F.split("stem", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return forms.select("since", F.explode(F.array_distinct(F.array_compact(F.array_append(ends, F.col("name"))))).alias("key"))


def broken_edges(edge: DataFrame, node: DataFrame) -> DataFrame:
    """edge_id, field, key, at, since: each reference of an edge whose note is not there.

    field `src` and `dst`: the path, character for character. field `raw` (only where dst is null):
    the cut link against every name, whole path without .md and end of such a path, by looks.
    Repeated rows count once.
    """
    spark = edge.sparkSession
    there = cut(note_states(node.select("path", "name", "removed_at", "seen_at")).filter("alive"))
    ref = lambda field, key: F.struct(F.lit(field).alias("field"), key.alias("key"))
    paths = edge.select(
        F.col("edge_id").alias("ref_id"), F.col("seen_at").alias("at"),
        F.explode(F.array(ref("src", F.col("src")), ref("dst", F.col("dst")))).alias("r"),
    ).select("ref_id", "r.field", "r.key", "at")
    by_path = orphan_references(paths, there.select(F.col("path").alias("key"), "since"))
    keys = _look_keys(there)
    links = cut(edge.filter(F.col("dst").isNull()).select(F.col("edge_id").alias("ref_id"), F.lit("raw").alias("field"), look_form(spark, link_part(F.col("raw"))).alias("key"), F.col("seen_at").alias("at")))
    by_look = orphan_references(links, cut(keys.groupBy("key").agg(F.min("since").alias("since"))))
    return by_path.unionByName(by_look).withColumnRenamed("ref_id", "edge_id")


def orphan_report(orphans: DataFrame, node: DataFrame, table: str = "edge") -> DataFrame:
    """table, field, month, reason, n: orphans for each field, month of the reference and reason.

    missing: no such note; deleted: all its rows are removed; late: it comes after the reference.
    A link by looks (`raw`) is deleted if notes that look so were there and all of them are removed.
    References are counted by key before they meet the notes, so a hot key is one row a month.
    """
    states = cut(note_states(node))
    looks = _look_keys(states).select("key").distinct().select("key", F.lit(True).alias("was"))
    gone = states.filter("NOT alive").select(F.col("path").alias("key"), F.lit(True).alias("was"))
    counted = cut(orphans.groupBy("field", F.date_format("at", "yyyy-MM").alias("month"), "key", F.col("since").isNotNull().alias("late")).agg(F.count(F.lit(1)).alias("n")))
    known = counted.filter("field <> 'raw'").join(gone, "key", "left").unionByName(counted.filter("field = 'raw'").join(looks, "key", "left"))
    reason = F.when(F.col("late"), "late").when(F.col("was"), "deleted").otherwise("missing")
    return known.select(F.lit(table).alias("table"), "field", "month", reason.alias("reason"), "n").groupBy("table", "field", "month", "reason").agg(F.sum("n").alias("n"))
