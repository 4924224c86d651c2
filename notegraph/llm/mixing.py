"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegraph.operators.skew import prefix_sums
from notegraph.session import cut

#: Tokens of a block, unless the caller says otherwise.
BLOCK = 4096
#: Slots of a schedule, and so the rows that are broadcast, are at most this many and one more for each
#: source. A selection of more blocks is a number of epochs, each with its part of every quota, that
#: follow the same schedule.
MAX_SLOTS = 100_000
#: A target list is a configuration; it is read by the driver and may not be longer.
MAX_SOURCES = 10_000


def schedule(quotas: list[int], block: int) -> list[tuple[int, int]]:
    """(source, its block) for each slot, in order.

    Block j of a source with share u = quota / sum is released in slot floor(j / u) and due by slot
    ceil((j + 1) / u). Of the released blocks the one with the earliest deadline is next, so after
    every slot each source is less than one block away from its share.
    """
    total = sum(quotas)
    slots = -(-total // block)
    heap, waiting = [], []
    for s, q in enumerate(quotas):
        if q > 0:
            heapq.heappush(waiting, (0, -(-total // q), s, 0))
    out = []
    t = 0
    while (heap or waiting) and len(out) < slots + len(quotas):
        while waiting and waiting[0][0] <= t:
            release, due, s, j = heapq.heappop(waiting)
            heapq.heappush(heap, (due, s, j))
        if heap:
            _, s, j = heapq.heappop(heap)
            out.append((s, j))
            if (j + 1) * block < quotas[s]:
                heapq.heappush(waiting, ((j + 1) * total // quotas[s], -(-(j + 2) * total // quotas[s]), s, j + 1))
        t += 1
    return out


def emitted_lags(selection: DataFrame, quotas: DataFrame, block: int, slots: int) -> DataFrame:
    """source, lag: by how many blocks the tokens really emitted of a source are away from its share at most.

    quotas: source, quota; slots: of one epoch. Between two of its own slots a source only falls
    behind, so it is enough to look before and after each of them, and at the end. The running
    totals are those of the epochs before, one row for each epoch and source, and those inside an
    epoch, of at most MAX_SLOTS slots and one more for each source.
    """
    own = cut(selection.groupBy("slot", "source").agg(F.sum("size").alias("n")).withColumn("epoch", F.floor(F.col("slot") / max(slots, 1))))
    by_epoch = cut(own.groupBy("epoch", "source").agg(F.sum("n").alias("n")))
    before = lambda w: F.coalesce(F.sum("n").over(w.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = by_epoch.select("epoch", "source", before(Window.partitionBy("source")).alias("got_before"))
    total = by_epoch.groupBy("epoch").agg(F.sum("n").alias("n")).select("epoch", before(Window.partitionBy()).alias("total_before"))
    upto = lambda *c: F.sum("n").over(Window.partitionBy(*c).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    run = own.select("epoch", "source", "n", upto("epoch").alias("total"), upto("epoch", "source").alias("got")).join(got, ["epoch", "source"]).join(total, "epoch")
    run = run.select("source", "n", (F.col("total") + F.col("total_before")).alias("total"), (F.col("got") + F.col("got_before")).alias("got"))
    sums = by_epoch.groupBy("source").agg(F.sum("n").alias("got"))
    whole = quotas.agg(F.sum("quota").alias("all")).crossJoin(F.broadcast(by_epoch.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))))
    end = quotas.join(sums, "source", "left").crossJoin(F.broadcast(whole.select("total"))).select("source", F.lit(0).cast("bigint").alias("n"), "total", F.coalesce("got", F.lit(0)).alias("got"))
    share = F.when(F.col("all") > 0, F.col("quota") / F.col("all")).otherwise(F.lit(0.0))
    off = run.unionByName(end).join(F.broadcast(quotas), "source").crossJoin(F.broadcast(whole.select("all"))).withColumn("share", share)
    after, first = F.abs(F.col("share") * F.col("total") - F.col("got")), F.abs(F.col("share") * (F.col("total") - F.col("n")) - (F.col("got") - F.col("n")))
    return off.groupBy("source").agg((F.max(F.greatest(after, first)) / block).alias("lag"))


def plan(totals: dict[str, int], targets: list[tuple[str, float, int]], size: int | None = None) -> list[dict]:
    """The quota in tokens of each target: source, weight, max_repeat, available, target, quota.

    Sources without a token can't contribute; the weights of the others are scaled to 1. With no
    `size` given, the selection is the largest in which no source with documents falls short. With
    a `size`, a source gives what it can up to max_repeat times, and falls short where that is less.
    """
    rows = [{"source": s, "weight": w or 0.0, "max_repeat": r if r is not None else 1, "available": totals.get(s, 0)} for s, w, r in targets]
    usable = [x for x in rows if x["weight"] > 0 and x["available"] > 0 and x["max_repeat"] > 0]
    weight = sum(x["weight"] for x in usable)
    if size is None:
        size = min((int(x["available"] * x["max_repeat"] * weight / x["weight"]) for x in usable), default=0)
    for x in rows:
        share = x["weight"] / weight if x in usable else 0.0
        x["target"] = int(size * share)
        x["quota"] = min(x["target"], x["available"] * x["max_repeat"])
    return rows


def mix(documents: DataFrame, targets: DataFrame, size: int | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(selection, shares).

    documents: doc_id, source, size. targets: source, weight, max_repeat. Both may be empty, which
    selects nothing. Documents of other or null sources and of null or no size are never selected;
    a target listed twice counts with its first row by weight.

    selection: slot, source, doc_id, pass, size - the documents in the order of the schedule; pass
    numbers the uses of a document from 0. Each source is a stream of its documents in hash order,
    repeated at most max_repeat times and cut after the last document of which at least half lies
    in the quota, so a source misses its quota by half a document at most. The stream lies in blocks
    of `block` tokens; the schedule interleaves the blocks, and a document comes with the block in
    which it starts. A selection of more than MAX_SLOTS blocks is cut into epochs with equal parts of
    every quota, which follow one schedule, so every source is at its share at the end of each. size: tokens of the whole
    selection; None: as many as possible without a source falling short.

    shares: source, weight, target, size, share, documents, uses, short (target - size), lag. lag is
    measured on what is emitted, in blocks: the schedule keeps it under one, and documents that
    reach over the end of their block add their overhang.
    """
    spark = documents.sparkSession
    listed = targets.filter("source IS NOT NULL").groupBy("source").agg(F.max(F.struct("weight", "max_repeat")).alias("t")).select("source", "t.*")
    wanted = [tuple(r) for r in listed.orderBy("source").limit(MAX_SOURCES + 1).collect()]
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    docs = documents.select("doc_id", "source", F.col("size").cast("bigint").alias("size")).filter("size > 0 AND doc_id IS NOT NULL")
    docs = cut(docs.join(F.broadcast(listed.select("source")), "source", "left_semi"))  # at most MAX_SOURCES rows
    totals = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum("size").alias("n")).collect()}  # at most MAX_SOURCES rows
    rows = plan(totals, wanted, size)
    quotas = [x["quota"] for x in rows]
    block = max(1, block)
    epochs = max(1, -(-sum(quotas) // (block * MAX_SLOTS)))
    order = schedule([-(-q // epochs) for q in quotas], block)
    slots = spark.createDataFrame([(rows[s]["source"], j, t) for t, (s, j) in enumerate(order)], "source string, block bigint, in_epoch bigint")
    limits = spark.createDataFrame([(x["source"], x["quota"], x["available"], x["max_repeat"]) for x in rows], "source string, quota bigint, available bigint, max_repeat int")
    placed = prefix_sums(docs, ["source"], [F.xxhash64("doc_id"), F.col("doc_id")], "size", "start", rows=docs.count()).join(F.broadcast(limits), "source")
    half = F.floor((F.col("size") + 1) / 2)
    passes = F.least(F.floor((F.col("quota") - F.col("start") - half) / F.col("available")), F.col("max_repeat") - 1).cast("int")
    uses = placed.filter(F.col("start") + half <= F.col("quota")).withColumn("pass", F.explode(F.sequence(F.lit(0), passes)))
    uses = uses.withColumn("at", F.col("pass") * F.col("available") + F.col("start"))
    # epoch e of a source starts at its token floor(e * quota / epochs)
    at = F.least("at", F.col("quota") - 1)
    uses = uses.withColumn("epoch", F.expr(f"(least(at, quota - 1) * {epochs} + {epochs} - 1) div quota"))
    uses = uses.withColumn("block", F.floor((at - F.expr(f"epoch * quota div {epochs}")) / block))
    selection = uses.join(F.broadcast(slots), ["source", "block"]).withColumn("slot", F.col("epoch") * len(order) + F.col("in_epoch"))
    selection = cut(selection.select("slot", "source", "doc_id", "pass", "size", "at"))
    lags = emitted_lags(selection, limits.select("source", "quota"), block, len(order))
    info = spark.createDataFrame([(x["source"], x["weight"], x["target"]) for x in rows], "source string, weight double, target bigint")
    got = selection.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.when(F.col("pass") == 0, 1)).alias("documents"), F.count(F.lit(1)).alias("uses"))
    whole = got.agg(F.sum("size").alias("whole"))
    shares = info.join(F.broadcast(got), "source", "left").join(F.broadcast(lags), "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "weight", "target", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce(F.col("size") / F.col("whole"), F.lit(0.0)).alias("share"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("uses", F.lit(0)).alias("uses"), (F.col("target") - F.coalesce("size", F.lit(0))).alias("short"), F.coalesce("lag", F.lit(0.0)).alias("lag"),
    )
    return selection, shares
