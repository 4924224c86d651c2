"""Helpers against hot keys: they bound what one task or one broadcast may hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot when it holds at least this share of all rows; so there are at most 64 hot keys.
HOT_SHARE = 1 / 64
#: So many rows fit in one task, whatever their keys; a caller that knows its rows skips the sketch.
SMALL_ROWS = 200_000

#: Rows of a bucket that one window sorts.
PREFIX_ROWS = 500_000


def heavy_keys(df: DataFrame, key: str, share: float = HOT_SHARE, tracked: int = 4096, rows: int | None = None) -> list:
    """Keys that hold at least `share` of the non-null rows: at most 1/share of them, by construction.

    One pass with a frequent-items sketch of `tracked` counters. A key the sketch misses only
    costs speed, never a row. rows: the number of rows, if known; few need no special care.
    """
    if rows is not None and rows <= SMALL_ROWS:
        return []
    most = int(1 / share)
    got = df.filter(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {most}, {tracked})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    if not got or not got["n"]:
        return []
    return [x[0] for x in got["top"] if x[1] >= max(2, share * got["n"])]


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str, hot: list) -> DataFrame:
    """left JOIN right on `key`, where `right` has one row for each key.

    The rows of `hot` keys never meet in one task: their counterparts, at most len(hot) rows, are
    broadcast. `how` is inner or left.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = left.filter(~is_hot).join(right, key, how)
    return cold.unionByName(left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how))


def prefix_sums(df: DataFrame, group: list[str], order: list[Column], value: str, out: str, rows: int | None = None) -> DataFrame:
    """Sum of `value` over the rows of the same group that come before, without one task per group.

    Rows lie in `salts` buckets by hash; the order is bucket, then `order`. The sum of a bucket's
    predecessors is taken over at most `salts` rows for each group, that inside a bucket over the
    bucket, so that a group with a third of all rows is spread over `salts` tasks. rows: of `df`, if
    known; there are as many buckets as keep one under PREFIX_ROWS even if all rows are one group's.
    """
    salts = max(64, -(-(df.count() if rows is None else rows) // PREFIX_ROWS))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sums = salted.groupBy(*group, "_salt").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_salt").alias("_s"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    part = salted.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_salt") == F.col("_s")]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    return part.join(base, cond, "left").withColumn(out, F.col("_in") + F.col("_base")).drop("_salt", "_in", "_base", "_s", *[f"_g{i}" for i in range(len(group))])
