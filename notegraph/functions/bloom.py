"""Bloom filters as lazy column expressions (JVM side, inside code generation)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.session import cut

#: Bits of one filter at most (8 MB). More keys go to several filters by their hash, MAX_FILTERS at
#: most: the proven bound of what is broadcast is 256 MB, which takes some 179 million keys. Beyond
#: that nothing is filtered, and all keys go to the exact join that verifies the positives anyway.
MAX_BITS = 8 * 8 * 1024 * 1024
BITS_PER_KEY = 12
MAX_FILTERS = 32


@dataclass(frozen=True)
class Bloom:
    """Filters by part of the key's hash; none: nothing can be told, everything may be in it."""

    filters: tuple[Column, ...]

    def __bool__(self) -> bool:
        return bool(self.filters)


def _column(jc) -> Column:
    from pyspark.sql.classic.column import Column as Classic

    return Classic(jc)


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(parts), key), F.lit(parts)).cast("int")


def _filter(df: DataFrame, key: Column, items: int) -> Column:
    """The Bloom filter of `key` as an aggregate."""
    jvm = df.sparkSession._jvm
    utils, ex = jvm.org.apache.spark.sql.classic.ExpressionUtils, jvm.org.apache.spark.sql.catalyst.expressions
    bits = max(1024, min(MAX_BITS, items * BITS_PER_KEY))
    args = [utils.expression(c._jc) for c in (F.xxhash64(key), F.lit(max(1, min(items, 4_000_000))).cast("long"), F.lit(bits).cast("long"))]
    return _column(utils.column(ex.aggregate.BloomFilterAggregate(*args).toAggregateExpression()))


def bloom_of(df: DataFrame, key: Column, items: int) -> Bloom:
    """The Bloom filters of `key` over `df`, as many as `items` keys need.

    One filter is a scalar subquery. Several are built once, each by one task from the keys of its
    part, and written to the shared folder.
    """
    parts = -(-max(items, 1) * BITS_PER_KEY // MAX_BITS)
    if parts > MAX_FILTERS:
        return Bloom(())
    if parts == 1:
        return Bloom((df.select(_filter(df, key, items).alias("filter")).scalar(),))
    by_part = df.filter(key.isNotNull()).select(key.alias("key")).withColumn("part", _part(F.col("key"), parts)).repartition(parts, "part")
    each = -(-items // parts)
    built = cut(by_part.groupBy("part").agg(_filter(by_part, F.col("key"), each).alias("filter")))
    return Bloom(tuple(built.filter(F.col("part") == p).select("filter").scalar() for p in range(parts)))


def might_contain(df: DataFrame, bloom: Bloom, key: Column) -> Column:
    """False: `key` is certainly not in the filter. An empty filter (null) contains nothing."""
    if not bloom:
        return F.lit(True)
    jvm = df.sparkSession._jvm
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    hashed = F.xxhash64(key)
    hits = [_column(utils.column(jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(utils.expression(f._jc), utils.expression(hashed._jc)))) for f in bloom.filters]
    hit = hits[0]
    if len(hits) > 1:
        part = _part(key, len(hits))
        hit = F.when(part == 0, hits[0])
        for p, h in enumerate(hits[1:], 1):
            hit = hit.when(part == p, h)
    return F.coalesce(hit, F.lit(False))
