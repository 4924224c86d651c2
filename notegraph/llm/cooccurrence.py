"""Items that appear together: stripes of co-occurring neighbours, scored by log-likelihood ratio."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.operators.skew import heavy_keys, skew_join
from notegraph.session import cut

#: A basket with more items is cut into blocks of about half as many.
MAX_BASKET = 2000
#: Partial counts a task holds before it merges them.
MERGE_ROWS = 1_000_000
#: A list of at most so many frequent items is broadcast; the bound follows from the support.
BROADCAST_ITEMS = 100_000
#: Cells of a stripe from which on it travels in parts, by the hash of the neighbour; and how many parts
#: at least. There are more where the frequent items are many, so that a part has PART_CELLS cells at most.
LONG_STRIPE, LEAST_PARTS, PART_CELLS = 1_000, 64, 100_000
_SCHEMA = "item string, part int, neighbours array<string>, counts array<bigint>"
_ARROW = pa.schema([("item", pa.string()), ("part", pa.int32()), ("neighbours", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _merge(parts: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(parts).group_by(["a", "b"]).aggregate([("n", "sum")])
    return pa.table({"a": t["a"], "b": t["b"], "n": t["n_sum"]})


def _pairs(batch: pa.RecordBatch) -> pa.Table:
    """Counts of the pairs in a batch of baskets: all of `left`, or `left` with `right` where that is set."""
    left, right = batch.column("left"), batch.column("right")
    both = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode()
    ids, words = both.indices.to_numpy(zero_copy_only=False).astype(np.int64), both.dictionary
    order = np.argsort(np.array(words.to_pylist(), dtype=object), kind="stable") if len(words) else np.zeros(0, np.int64)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    ids, words, base = rank[ids], words.take(pa.array(order)), len(words)
    cut_at = len(left.flatten())
    n_left = np.nan_to_num(left.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    n_right = np.nan_to_num(right.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    at_left, at_right = np.cumsum(n_left) - n_left, cut_at + np.cumsum(n_right) - n_right
    cross = right.is_valid().to_numpy(zero_copy_only=False)
    codes = [np.zeros(0, np.int64)]
    for size in np.unique(n_left[~cross & (n_left > 1)]):
        rows = np.nonzero(~cross & (n_left == size))[0]
        i, j = np.triu_indices(size, 1)
        step = max(1, 4_000_000 // len(i))
        for k in range(0, len(rows), step):
            m = ids[at_left[rows[k : k + step], None] + np.arange(size)]
            x, y = m[:, i].ravel(), m[:, j].ravel()
            codes.append(np.minimum(x, y) * base + np.maximum(x, y))
    for r in np.nonzero(cross)[0]:
        x, y = ids[at_left[r] : at_left[r] + n_left[r], None], ids[None, at_right[r] : at_right[r] + n_right[r]]
        codes.append((np.minimum(x, y) * base + np.maximum(x, y)).ravel())
    code, n = np.unique(np.concatenate(codes), return_counts=True)
    return pa.table({"a": words.take(pa.array(code // max(base, 1))), "b": words.take(pa.array(code % max(base, 1))), "n": pa.array(n, pa.int64())})


def _parts(neighbours: pa.Array, parts: int) -> np.ndarray:
    """The part of each neighbour, the same in every process."""
    own = neighbours.dictionary_encode()
    of = np.array([zlib.crc32(w.encode()) % parts for w in own.dictionary.to_pylist()], np.int32)
    return of[own.indices.to_numpy()] if len(of) else np.zeros(0, np.int32)


def _stripes(parts: int):
    """In-mapper combining: one stripe for each item and task (or as often as memory asks), a long one in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = _merge(held).combine_chunks()
            held.clear()
            if t.num_rows:
                a = t["a"].combine_chunks().dictionary_encode()
                item = a.indices.to_numpy()
                part = np.where(np.bincount(item)[item] > LONG_STRIPE, _parts(t["b"].combine_chunks(), parts), 0).astype(np.int32)
                order = np.lexsort((part, item))
                item, part = item[order], part[order]
                t = t.take(pa.array(order)).combine_chunks()
                firsts = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (part[1:] != part[:-1])))
                starts = pa.array(np.append(firsts, len(item)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(starts, t[c].combine_chunks()) for c in ("b", "n")]
                whole = pa.RecordBatch.from_arrays([a.dictionary.take(pa.array(item[firsts])), pa.array(part[firsts]), *lists], schema=_ARROW)
                for k in range(0, whole.num_rows, 10_000):
                    yield whole.slice(k, 10_000)

        for batch in batches:
            held.append(_pairs(batch))
            if sum(t.num_rows for t in held) > MERGE_ROWS:
                held[:] = [_merge(held)]
                if held[0].num_rows > MERGE_ROWS // 2:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge stripes that follow each other by item and part; only one part of one stripe is held over a batch's end."""
    rest: pa.Table | None = None
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        items, lists = batch.column("item"), batch.column("neighbours")
        rows = pa.array(np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)))
        t = pa.table({"a": items.take(rows), "b": lists.flatten(), "n": batch.column("counts").flatten()})
        parts = batch.column("part").to_numpy()
        done = int(np.searchsorted(rows.to_numpy(), _tail_start(items, parts)))
        last = (items[-1].as_py(), int(parts[-1]))
        if rest is not None and (done or last != key):
            yield from _merge([rest, t.slice(0, done)]).combine_chunks().to_batches()
            rest = None
        elif done:
            yield from _merge([t.slice(0, done)]).combine_chunks().to_batches()
        rest, key = _merge([t.slice(done)] if rest is None else [rest, t.slice(done)]), last
    if rest is not None:
        yield from rest.combine_chunks().to_batches()


def _tail_start(items: pa.Array, parts: np.ndarray) -> int:
    """The first row of the last item and part of a batch."""
    same = pa.compute.equal(items, items[-1]).to_numpy(zero_copy_only=False) & (parts == parts[-1])
    other = np.flatnonzero(~same)
    return int(other[-1]) + 1 if len(other) else 0


def baskets(pairs: DataFrame, max_basket: int = MAX_BASKET, rows: int | None = None) -> DataFrame:
    """left, right: the items of each record; a record of more than `max_basket` items in blocks.

    The blocks of a large record meet two by two in different tasks, so no record is collected
    whole, whatever its size, and none of its pairs is lost.
    """
    sizes = pairs.groupBy("record").agg(F.count(F.lit(1)).alias("size"))
    large = cut(sizes.filter(F.col("size") > max_basket))
    none = F.lit(None).cast("array<string>")
    if large.isEmpty():
        return pairs.groupBy("record").agg(F.collect_list("item").alias("left")).filter(F.size("left") > 1).select("left", none.alias("right"))
    hot = heavy_keys(pairs, "record", rows=rows)
    small = skew_join(pairs, large.withColumn("is_large", F.lit(True)), "record", "left", hot).filter("is_large IS NULL")
    small = small.groupBy("record").agg(F.collect_list("item").alias("left")).filter(F.size("left") > 1).select("left", none.alias("right"))
    big = skew_join(pairs, large, "record", "inner", hot).withColumn("blocks", F.ceil(F.col("size") * 2 / max_basket).cast("int"))
    big = big.withColumn("own", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    met = big.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    met = met.select("record", lo.alias("lo"), hi.alias("hi"), "own", "item").groupBy("record", "lo", "hi").agg(
        F.collect_list(F.when(F.col("own") == F.col("lo"), F.col("item"))).alias("left"),
        F.collect_list(F.when(F.col("own") != F.col("lo"), F.col("item"))).alias("right"),
    )
    return small.unionByName(met.select("left", F.when(F.col("lo") != F.col("hi"), F.col("right")).alias("right")))


def cooccurrence(df: DataFrame, record: str, item: str, min_count: int = 1, min_share: float = 0.0) -> DataFrame:
    """item_a, item_b, n, n_a, n_b, total, lift, llr for every two items that share a record.

    item_a < item_b by code point; n records hold both, n_a and n_b each, of `total` records that
    hold any item. lift = n * total / (n_a * n_b); llr is Dunning's log-likelihood ratio (3.84: 5 %
    significance). Only pairs with n >= max(min_count, min_share * total) come out; items below
    that count can't be in one, so they are dropped before pairing.

    Stripes: each task merges the pairs of its records into one array of neighbours and counts per
    item; the arrays are shuffled by item and merged, one at a time. A long array travels in parts by
    the hash of the neighbour, so the stripe of an item that stands in every record is spread over
    many tasks; the counts of a pair that came in a short and in a long array are added last. Null
    records and items are ignored, repeats count once, the empty string is an item like others; no
    rows give no rows.
    """
    pairs = cut(df.select(F.col(record).cast("string").alias("record"), F.col(item).cast("string").alias("item")).filter("record IS NOT NULL AND item IS NOT NULL").distinct())
    size = pairs.agg(F.count_distinct("record").alias("records"), F.count(F.lit(1)).alias("rows")).first()
    total, rows = size["records"], size["rows"]
    least = max(min_count, min_share * total, 1)
    counts = cut(pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")))
    frequent = counts.filter(F.col("n") >= least)
    kept = pairs
    if least > 1:
        if rows / least <= BROADCAST_ITEMS:  # there can't be more items of this count
            kept = pairs.join(F.broadcast(frequent.select("item")), "item", "left_semi")
        else:
            kept = skew_join(pairs, frequent.select("item"), "item", "inner", heavy_keys(pairs, "item", rows=rows))
    parts = max(LEAST_PARTS, -(-frequent.count() // PART_CELLS))
    stripes = baskets(kept, rows=rows).mapInArrow(_stripes(parts), _SCHEMA)
    merged = stripes.repartition("item", "part").sortWithinPartitions("item", "part").mapInArrow(_merged, "a string, b string, n bigint")
    merged = cut(merged.groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    found = merged.count()
    for side in ("a", "b"):
        own = frequent.select(F.col("item").alias(side), F.col("n").alias(f"n_{side}"))
        if least > 1 and rows / least <= BROADCAST_ITEMS:
            merged = merged.join(F.broadcast(own), side)
        else:
            merged = skew_join(merged, own, side, "inner", heavy_keys(merged, side, rows=found))
    n, na, nb, tot = (F.col(c).cast("double") for c in ("n", "n_a", "n_b", "total"))
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))
    llr = 2 * (part(n, na * nb / tot) + part(na - n, na * (tot - nb) / tot) + part(nb - n, (tot - na) * nb / tot) + part(tot - na - nb + n, (tot - na) * (tot - nb) / tot))
    return merged.withColumn("total", F.lit(total).cast("bigint")).select(
        F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n", "n_a", "n_b", "total", (n * tot / (na * nb)).alias("lift"), llr.alias("llr")
    )
