"""Names of links to paths of notes: suffix keys and one equi join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.functions.text import is_note, nfc, path_dir
from notegraph.operators.skew import heavy_keys, skew_join
from notegraph.session import cut


def link_keys(targets: DataFrame) -> DataFrame:
    """key, path: everything a link may say to mean a file.

    That is its base name; and for a note its path without .md and every end of it after a slash.
    """
    path = F.col("path")
    parts = F.split(F.regexp_replace(path, r"\.md\z", ""), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    base = F.array(F.element_at(F.split(path, "/"), -1))
    keys = F.when(is_note(path), F.array_union(base, ends)).otherwise(base)
    return targets.select("path").filter(path.isNotNull()).distinct().select(F.explode(keys).alias("key"), "path")


def resolve(links: DataFrame, targets: DataFrame, rows: int | None = None) -> DataFrame:
    """`links` (src, target and more) with landed: the path each target means, or null.

    Of several files the first by path below the folder of `src` is meant, else the first at all;
    a link from the root prefers none. Distinct pairs of target and folder are resolved, so popular
    targets are joined once for each folder they are linked from. A target with C candidates
    costs C rows for each such folder. rows: of `links`, if known; few need no search for hot keys.
    """
    targets = cut(targets.select("path").filter("path IS NOT NULL").distinct())
    keyed = links.withColumn("_key", nfc(F.col("target"))).withColumn("_dir", path_dir(F.col("src")))
    asked = keyed.select("_key", "_dir").distinct()
    keys = link_keys(targets).groupBy("key").agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("n"))
    known = cut(skew_join(asked, keys.withColumnRenamed("key", "_key"), "_key", "inner", heavy_keys(asked, "_key", rows=rows)))
    # only ambiguous names ask for the folder: its ends are matched with the folders of the candidates
    doubtful = known.filter("n > 1 AND _dir <> ''").select("_key", "_dir")
    asked_keys = doubtful.select(F.col("_key").alias("key")).distinct()
    spots = link_keys(targets).join(asked_keys, "key", "left_semi").withColumn("_up", path_dir(F.col("path")))
    levels = F.split("_up", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(levels)), lambda i: F.array_join(F.slice(levels, 1, i), "/"))
    near = spots.filter("_up <> ''").select(F.col("key").alias("_key"), F.explode(ups).alias("_dir"), "path").groupBy("_key", "_dir").agg(F.min("path").alias("near"))
    chosen = doubtful.join(near, ["_key", "_dir"])
    answers = known.select("_key", "_dir", "first").join(chosen, ["_key", "_dir"], "left").select("_key", "_dir", F.coalesce("near", "first").alias("landed"))
    pair = F.concat_ws("\0", "_key", "_dir")
    one = answers.withColumn("_pair", pair).select("_pair", "landed")
    asked_rows = keyed.withColumn("_pair", pair)
    return skew_join(asked_rows, one, "_pair", "left", heavy_keys(asked_rows, "_pair", rows=rows)).drop("_pair", "_key", "_dir")


def duplicate_names(targets: DataFrame, notes_only: bool = False) -> DataFrame:
    """key, paths, n: base names (with and without .md) that several files have."""
    path = F.col("path")
    base = F.element_at(F.split(path, "/"), -1)
    keys = F.when(is_note(path), F.array(base, F.regexp_replace(base, r"\.md\z", ""))).otherwise(F.array(base))
    if notes_only:
        keys = F.when(is_note(path), F.array(F.regexp_replace(base, r"\.md\z", ""))).otherwise(F.array().cast("array<string>"))
    return targets.select("path").distinct().select(F.explode(keys).alias("key"), "path").groupBy("key").agg(F.array_sort(F.collect_list("path")).alias("paths"), F.count(F.lit(1)).alias("n")).filter("n > 1")


def case_collisions(targets: DataFrame) -> DataFrame:
    """folded, names: base names that differ in case only."""
    from notegraph.functions.text import casefold

    path = F.col("path")
    base = F.element_at(F.split(path, "/"), -1)
    keys = F.when(is_note(path), F.array(base, F.regexp_replace(base, r"\.md\z", ""))).otherwise(F.array(base))
    names = targets.select(F.explode(keys).alias("key")).distinct()
    return names.groupBy(casefold(F.col("key")).alias("folded")).agg(F.sort_array(F.collect_set("key")).alias("names")).filter(F.size("names") > 1)
