"""Filling containers of fixed capacity: bin completion with branch and bound."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.session import cut

#: Items of one packing task; and those of its worst containers that it hands to the next round.
GROUP_ITEMS = 20_000
HANDED_ON = GROUP_ITEMS // 8
#: Nodes (fillings tried) of the branch and bound of one group, beyond one for each container. A group
#: that uses them up keeps its best solution so far and says so (column `limited`).
NODES = 100_000
#: Sizes tried for a container's first filling before all of them are laid out.
QUICK = 4_000
#: Failed states that a search remembers.
REMEMBERED = 50_000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indices of `sizes` by container."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, container), sorted
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_right(room, (sizes[i] - 1, len(bins)))
        if at == len(room):
            bins.append([i])
            insort(room, (capacity - sizes[i], len(bins) - 1))
        else:
            left, b = room.pop(at)
            bins[b].append(i)
            insort(room, (left - sizes[i], b))
    return bins


def fullest(space: int, values: list[int], counts: dict[int, int], nodes: int) -> list[int]:
    """Of the fillings of `space` from the sizes `values` (ascending), the fullest found.

    Each node takes a size and how many of it. Depth first, larger items first, so that of two equally full ones that with the larger items
    wins, which dominates the other. A full one ends the search: nothing dominates it.
    """
    best: list[int] = []
    best_sum, visited = 0, 0
    stack: list[tuple[int, int]] = []  # (place in values, how many of it)
    left, at = space, len(values) - 1
    while True:
        at = min(at, bisect_right(values, left) - 1)
        if at >= 0:
            times = min(counts[values[at]], left // values[at])
        else:
            while stack:
                at, times = stack.pop()
                left += times * values[at]
                times -= 1
                if times:
                    break
                at -= 1
                if at >= 0:
                    break
            else:
                return best
            if not times:
                continue
        v = values[at]
        stack.append((at, times))
        left -= times * v
        visited += 1
        if space - left > best_sum or (0 < left < v and left in counts):
            best, best_sum = [values[i] for i, k in stack for _ in range(k)], space - left
            if 0 < left < v and left in counts:
                return [*best, left]
        if left == 0 or visited > nodes:
            return best
        at -= 1


def undominated(space: int, values: list[int], counts: dict[int, int], most: int | None = None) -> Iterator[list[int]]:
    """Fillings of `space` from the sizes `values` (ascending), fullest first, one at a time; waste at most `most`.

    Only undominated ones: no left-out item fits, nor does a larger left-out one in place of one or
    of two taken. Sums that the smaller sizes can't reach are never walked into.
    """
    values = values[: bisect_right(values, space)]
    reach = [1]  # bit s of reach[g]: some of the first g sizes fill s
    full = (1 << (space + 1)) - 1
    for v in values:
        bits, times, step = reach[-1], counts[v], 1
        while times > 0 and v * step <= space:  # 1, 2, 4 ... of it, then the rest
            step = min(step, times)
            bits |= bits << (v * step)
            times, step = times - step, step * 2
        reach.append(bits & full)
    top = sum(v * counts[v] for v in values)

    def dominated(taken: list[tuple[int, int]], waste: int) -> bool:
        left = {v: counts[v] for v in values}
        for v, k in taken:
            left[v] -= k
        out = [v for v in values if left[v]]
        if not out:
            return False
        if out[0] <= waste:
            return True
        ones = [v for v, k in taken for _ in range(min(k, 2))]
        sums = {*ones, *(a + b for n, a in enumerate(ones) for b in ones[n + 1 :])}
        return any((at := bisect_left(out, s if s not in ones else s + 1)) < len(out) and out[at] <= s + waste for s in sums)

    for waste in range(min(space, space if most is None else most) + 1):
        if not reach[-1] >> (space - waste) & 1 or (waste and top - (space - waste) > 0 and values[0] <= waste and counts[values[0]] * values[0] > space - waste):
            continue
        # (size, how many of it) from the largest; a stack, as containers may hold thousands of items
        stack: list[tuple[int, int]] = []
        at, left = len(values), space - waste
        while True:
            if left == 0:
                taken = [(values[g], k) for g, k in stack]
                if not dominated(taken, waste):
                    yield [v for v, k in taken for _ in range(k)]
            else:
                at = min(at, bisect_right(values, left))
                k = 0
                while at:
                    v = values[at - 1]
                    k = min(counts[v], left // v)
                    while k and not reach[at - 1] >> (left - k * v) & 1:
                        k -= 1
                    if k:
                        break
                    if not reach[at - 1] >> left & 1:
                        at = 0
                        break
                    at -= 1
                if at:
                    stack.append((at - 1, k))
                    left -= k * values[at - 1]
                    at -= 1
                    continue
            while stack:  # fewer of the last size
                g, k = stack.pop()
                v = values[g]
                left += k * v
                k -= 1
                while k and not reach[g] >> (left - k * v) & 1:
                    k -= 1
                if k:
                    stack.append((g, k))
                    left -= k * v
                    at = g
                    break
                if reach[g] >> left & 1:
                    at = g
                    break
            else:
                break


class _Stock:
    """The items left, by size."""

    def __init__(self, sizes: list[int]) -> None:
        self.counts: dict[int, int] = {}
        for s in sizes:
            self.counts[s] = self.counts.get(s, 0) + 1
        self.values = sorted(self.counts)

    def take(self, v: int) -> None:
        self.counts[v] -= 1
        if not self.counts[v]:
            del self.counts[v]
            self.values.pop(bisect_left(self.values, v))

    def put(self, v: int) -> None:
        if v not in self.counts:
            self.counts[v] = 0
            insort(self.values, v)
        self.counts[v] += 1


def _fillings(stock: _Stock, space: int, slack: int) -> Iterator[list[int]]:
    """Fillings around the largest item, undominated and with a waste of at most `slack`, the first one quickly."""
    first = fullest(space, stock.values, stock.counts, QUICK)
    quick = sum(first) == space
    if quick:
        yield first
        first = sorted(first, reverse=True)
    values, counts = list(stock.values), dict(stock.counts)
    for filling in undominated(space, values, counts, slack):
        if not quick or filling != first:
            yield filling


def complete(sizes: list[int], capacity: int, most: int, nodes: int) -> tuple[list[list[int]] | None, int]:
    """(containers as sizes, nodes used): a packing into at most `most` containers; None: there is none, or `nodes` are used up.

    The largest item left opens a container, its undominated fillings are branched on, fullest
    first. The space that `most` containers have beyond the items bounds the waste: what a container
    wastes is taken from it, and a filling that wastes more than is left is never tried.
    """
    stock, slack = _Stock(sizes), most * capacity - sum(sizes)
    if slack < 0:
        return None, 0
    frames: list[list] = []  # [largest, fillings, the one taken, slack before, state]
    failed: set = set()
    used = 0

    def open_frame(slack: int) -> None:
        head = stock.values[-1]
        state = hash((len(frames), tuple(stock.counts.items()))) if len(stock.counts) <= 256 else None
        stock.take(head)
        known = state is not None and state in failed
        frames.append([head, iter(()) if known else _fillings(stock, capacity - head, slack), None, slack, state])

    if stock.values:
        open_frame(slack)
    while frames:
        head, fillings, taken, slack, state = frame = frames[-1]
        if taken is not None:
            for v in taken:
                stock.put(v)
        if used > nodes:
            return None, used
        frame[2] = taken = next(fillings, None)
        if taken is None:
            if state is not None and len(failed) < REMEMBERED:
                failed.add(state)
            stock.put(head)
            frames.pop()
            continue
        used += 1
        for v in taken:
            stock.take(v)
        left = slack - (capacity - head - sum(taken))
        if not stock.values:
            return [[f[0], *f[2]] for f in frames], used
        if left < 0:
            continue
        open_frame(left)
    return ([], used) if not sizes else (None, used)


def branch_and_bound(sizes: list[int], capacity: int, nodes: int = NODES) -> tuple[list[list[int]], bool]:
    """(indices of `sizes` by container, whether the nodes were used up before the optimum was sure).

    Best fit is the incumbent. Packings with the least containers that the sum allows are searched
    for first, then with one more, until one is found or the incumbent is as good. Nodes: `nodes`,
    and one for each container of the incumbent, so that a search can always get to its end.
    """
    best = best_fit(sizes, capacity)
    least, budget = -(-sum(sizes) // capacity), nodes + len(best)
    limited = False
    for most in range(least, len(best)):
        found, used = complete(sizes, capacity, most, budget)
        budget -= used
        if found is not None:
            by_size: dict[int, list[int]] = {}
            for i, s in enumerate(sizes):
                by_size.setdefault(s, []).append(i)
            return [[by_size[v].pop() for v in b] for b in found], limited
        limited = limited or budget < 0
        budget = max(budget, len(best))
    return best, limited


def pack(sizes: list[int], capacity: int, nodes: int = NODES) -> tuple[list[list[int]], bool]:
    """(indices of `sizes`, none above `capacity`, by container; whether the search was limited).

    Items of size 0 take no room and go to the first container.
    """
    kept = [i for i, s in enumerate(sizes) if s]
    bins, limited = branch_and_bound([sizes[i] for i in kept], capacity, nodes)
    bins = [[kept[k] for k in b] for b in bins]
    if len(kept) < len(sizes):
        free = [i for i, s in enumerate(sizes) if not s]
        bins = [[*(bins[0] if bins else []), *free], *bins[1:]]
    return bins, limited


def _pack_group(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        sizes = table["size"].to_pylist()
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], table["id"][i].as_py(), table["piece"][i].as_py()))
        table, sizes = table.take(order), [sizes[i] for i in order]
        bins, limited = pack(sizes, capacity)
        at, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for b, items in enumerate(bins):
            at[items], fill[items] = b, sum(sizes[i] for i in items)
        worst, handed = set(), 0
        for b in sorted(range(len(bins)), key=lambda b: (fill[bins[b][0]], b)):
            if fill[bins[b][0]] >= capacity or handed + len(bins[b]) > HANDED_ON:
                break
            worst.add(b)
            handed += len(bins[b])
        return table.append_column("bin", pa.array(at)).append_column("open", pa.array([b in worst for b in at.tolist()], pa.bool_())).append_column("limited", pa.array([limited] * len(sizes), pa.bool_()))

    return run


def fill_containers(items: DataFrame, capacity: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """container, id, piece, size, limited: every item in a container of `capacity`.

    items: id (unique), size. An item stays whole unless it alone exceeds the capacity; then its
    pieces are full containers and a rest that is packed like an item. A null or negative size
    counts as 0 and takes no room.

    Items are spread by hash over groups of about `group_items`, each packed by one task. A group
    hands the items of its worst containers, at most an eighth, to the next round with an eighth of
    the groups, so the space left unused at the ends of groups is filled, and the rounds are few.
    limited: the group's search used up its nodes before its number of containers was sure.
    """
    size = F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("bigint")
    base = items.select(F.col("id"), size.alias("size")).withColumn("full", F.floor(F.col("size") / capacity).cast("int"))
    rest = F.col("size") - F.col("full") * capacity
    parts = F.transform(F.sequence(F.lit(0), F.col("full")), lambda i: F.struct(i.alias("piece"), F.when(i < F.col("full"), F.lit(capacity)).otherwise(rest).cast("bigint").alias("size")))
    pieces = base.select("id", F.explode(F.filter(parts, lambda p: (p["size"] > 0) | (p["piece"] == 0))).alias("p")).select("id", "p.piece", "p.size")
    pieces = cut(pieces)
    done = [pieces.filter(F.col("size") == capacity).select(F.concat_ws("-", F.lit("full"), "id", "piece").alias("container"), "id", "piece", "size", F.lit(False).alias("limited"))]
    todo, level = pieces.filter(F.col("size") < capacity), 0
    n = todo.count()
    while n:
        groups = max(1, -(-n // group_items))
        kind = "id bigint, piece int, size bigint, grp int, bin bigint, open boolean, limited boolean"
        grouped = todo.withColumn("grp", F.pmod(F.xxhash64("id", "piece", F.lit(level)), F.lit(groups)).cast("int"))
        packed = cut(grouped.groupBy("grp").applyInArrow(_pack_group(capacity), kind))
        name = F.concat_ws("-", F.lit(level), "grp", "bin").alias("container")
        last = groups == 1
        done.append((packed if last else packed.filter("NOT open")).select(name, "id", "piece", "size", "limited"))
        if last:
            break
        todo, level = packed.filter("open").select("id", "piece", "size"), level + 1
        n = todo.count()
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """containers, least (no packing can do with fewer), size, unused, used_share, limited (containers of groups whose search was cut short)."""
    limited = F.count_distinct(F.when(F.col("limited"), F.col("container"))).alias("limited")
    sums = packed.agg(F.count_distinct("container").alias("containers"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), limited)
    room = F.col("containers") * capacity
    return sums.select(
        "containers", F.ceil(F.col("size") / capacity).alias("least"), "size", (room - F.col("size")).alias("unused"), F.when(room > 0, F.col("size") / room).alias("used_share"), "limited"
    )
