"""Long exact spans that stand in several records, found by recompression.

Every text is a sequence of symbols, at first its characters. In each round, runs of one symbol
(in RUN_ROUNDS) and pairs of neighbouring symbols get names. A name is a hash of what it stands
for, so the same run or pair has one name all over the corpus without an exchange for each round.
Which pairs are named is decided by one bit of each symbol (left or right), so equal substrings get
equal interior symbols; only symbols at the rim of a substring may be named together with what
stands around it. Only symbols within the LIMITS of a round are named further, so symbols grow
evenly, at last to the scale of the span.

Every window of LEAST characters is followed through the rounds. A symbol at its rim that might be
named together with an outside one is taken off, whatever really stands outside; so what is left
depends on the window alone, not on where it stands. The high-level symbols that still fill CORE
characters, in the last round looked at in which they do, are the window's core. Two records that share a
span of LEAST characters thus have a core in common, at the same place of the span. Neighbouring
windows mostly have the same core: there is about one for every 30 characters.

The cores are the join keys. Records that share one are held against each other in the text around
it. Where many records share a core, or a record repeats it periodically, the windows themselves
are named, by the symbols taken off at their rims and the core, and records that share a window
are verified in its text; so no group is compared all against all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.functions.bloom import bloom_of, might_contain
from notegraph.llm.lookalikes import expand
from notegraph.session import cut

LEAST = 200
#: Characters that a core covers at least.
CORE = 64
#: Most characters of a symbol that is named further, by round; runs are named in RUN_ROUNDS.
LIMITS = (1, 1, 2, 2, 3, *(int(4 * 1.2**i) for i in range(16)))
RUN_ROUNDS = (0, 4)
#: From this round on (and after runs) the windows are held against CORE; before, few characters are taken off.
LOOK_ROUND = 8
#: Characters named at a time; longer texts come in pieces.
CHUNK = 250_000
#: Rows of a key in one task from which on the further ones are spread over many tasks, and the
#: counters by which a task knows (a collision only spreads a key that needn't be).
HOT_IN_TASK = 8
COUNTERS = 1 << 22
#: Rows of a key that are compared pair by pair; larger groups are split by their windows.
PAIRWISE = 32
_SEP = np.uint32(0xFFFFFFFF)
_WALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_PAIR, _RUN, _BASE = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x5851F42D4C957F2D))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _sequence_names(name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Names of the sequences of symbols from `lo` up to `hi`."""
    power, inverse = _powers(max(CHUNK, 1 << len(name).bit_length()))
    sums = np.zeros(len(name) + 1, np.uint64)
    np.cumsum(_mix(name) * power[: len(name)], out=sums[1:])
    return _mix((sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))


def _steps() -> Iterator[tuple[int, int, bool]]:
    """(round, most characters of a symbol that is named further, whether runs are named)."""
    for r, limit in enumerate(LIMITS):
        if r in RUN_ROUNDS:
            yield r, limit, True
        yield r, limit, False


def symbols(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, start) of the characters; _SEP separates texts and is never named further."""
    table = _basic_names()
    name = table[codes & np.uint32(0xFFFF)]
    other = np.flatnonzero(codes > 0xFFFF)
    name[other] = _mix(codes[other].astype(np.uint64))
    name[other[codes[other] == _SEP]] = _WALL
    return name, np.arange(len(codes) + 1, dtype=np.int32)


@lru_cache(1)
def _basic_names() -> np.ndarray:
    return _mix(np.arange(1 << 16, dtype=np.uint64))


def compress(name: np.ndarray, start: np.ndarray, r: int, limit: int, runs: bool):
    """One step of a round: (name, start, inner_lo, inner_hi, longest).

    start has the end of the last symbol, too. inner_lo[i], inner_hi[i]: where a window of old
    symbols from i, up to i (not including it) begins and ends among the new ones, without the
    symbol or run at its rim that might be named together with what stands around the window; that
    takes at most `longest` characters off each side.
    """
    active = (start[1:] - start[:-1] <= limit) & (name != _WALL)
    first = np.ones(len(start), bool)
    if runs:
        first[1:-1] = (name[1:] != name[:-1]) | ~active[1:]
        left = right = active
    else:
        bit = (name.view(np.uint8)[r >> 3 :: 8] >> np.uint8(r & 7)) & 1 == 1
        left, right = active & bit, active & ~bit
        pair = np.flatnonzero(right[:-1] & left[1:])
        first[pair + 1] = False
    at = np.cumsum(first[:-1], dtype=np.int32)
    new, new_start, longest = name[first[:-1]], start[first], limit
    if runs:
        many, more = np.unique(at[np.flatnonzero(~first[:-1])] - 1, return_counts=True)
        new[many] = _mix(new[many] * _RUN + (more + 1).astype(np.uint64))
        longest = max(limit, int((new_start[many + 1] - new_start[many]).max(initial=0)))
    else:
        new[at[pair] - 1] = _mix(name[pair] * _PAIR + _mix(name[pair + 1] + np.uint64(r)))
    # of what is loose at a rim, the next symbol is the first of a new one, and so is a loose one at the end
    return new, new_start, np.append(at - 1 + left, np.int32(len(new))), np.append(np.int32(0), at - right), longest


def cores(codes: np.ndarray, begin: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(name, position) of the cores of the windows that begin at `begin` (ascending), repeats once."""
    name, start = symbols(codes)
    lo, hi = begin.astype(np.int32), begin.astype(np.int32) + np.int32(least)
    names, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    before, since, lost = [], [], 0  # the steps up to the last look, those after it, and what they can take off
    old = name, start  # as of the last look

    def follow(lo: np.ndarray, hi: np.ndarray, steps: list) -> tuple[np.ndarray, np.ndarray]:
        if not steps:
            return lo, hi
        to_lo, to_hi = steps[-1]
        for step_lo, step_hi in steps[-2::-1]:  # from the last, as the later ones have fewer symbols
            to_lo, to_hi = to_lo[step_lo], to_hi[step_hi]
        return to_lo[lo], to_hi[hi]

    for r, limit, runs in _steps():
        if not len(lo):
            break
        name, start, inner_lo, inner_hi, longest = compress(name, start, r, limit, runs)
        since.append((inner_lo, inner_hi))
        lost += 2 * longest
        if not runs and r < LOOK_ROUND:
            continue
        if lost <= least - CORE:  # no window of this chunk can be under CORE yet
            before, since, old = before + since, [], (name, start)
            continue
        lo, hi = follow(lo, hi, before)
        new_lo, new_hi = follow(lo, hi, since)
        lasts = start[new_hi] - start[new_lo] >= CORE
        if not lasts.all():
            was, begins = old
            a, b = _distinct(lo[~lasts], hi[~lasts])
            names.append(_sequence_names(was, a, b))
            places.append(begins[a])
            new_lo, new_hi = new_lo[lasts], new_hi[lasts]
        lo, hi = _distinct(new_lo, new_hi)
        before, since, old = [], [], (name, start)
    if len(lo):
        lo, hi = _distinct(*follow(lo, hi, before + since))
        names.append(_sequence_names(name, lo, hi))
        places.append(start[lo])
    return np.concatenate(names), np.concatenate(places).astype(np.int64)


def _distinct(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(lo):
        return lo, hi
    new = np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
    return lo[new], hi[new]


def window_names(codes: np.ndarray, begin: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Two names of each window: of what the rounds took off at its left and right, and of its core."""
    name, start = symbols(codes)
    lo, hi, at = begin.astype(np.int32), begin.astype(np.int32) + np.int32(least), np.arange(len(begin))
    off = np.zeros((2, len(begin)), np.uint64)
    out = np.zeros((2, len(begin)), np.uint64)

    def finish(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, r: int) -> None:
        core = _sequence_names(name, lo, hi)
        out[0, rows], out[1, rows] = _mix(off[0, rows] * _PAIR + core), _mix(off[1, rows] * _RUN + core + np.uint64(r))

    for r, limit, runs in _steps():
        if not len(lo):
            break
        new, new_start, inner_lo, inner_hi, _ = compress(name, start, r, limit, runs)
        new_lo, new_hi = inner_lo[lo], inner_hi[hi]
        lasts = new_start[new_hi] - new_start[new_lo] >= CORE
        finish(at[~lasts], lo[~lasts], hi[~lasts], r)
        lo, hi, new_lo, new_hi, at = lo[lasts], hi[lasts], new_lo[lasts], new_hi[lasts], at[lasts]
        cut_lo, cut_hi = np.searchsorted(start, new_start[new_lo]), np.searchsorted(start, new_start[new_hi])
        taken = _sequence_names(name, lo, cut_lo), _sequence_names(name, cut_hi, hi)
        for k, c in enumerate((_PAIR, _RUN)):
            off[k, at] = _mix(_mix(off[k, at] * c + taken[0]) * c + taken[1])
        lo, hi, name, start = new_lo, new_hi, new, new_start
    finish(at, lo, hi, len(LIMITS))
    return out[0].view(np.int64), out[1].view(np.int64)


def _chunks(ids: list, texts: list, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, ids, first positions, offsets) of runs of texts, each followed by _SEP.

    A text of more than CHUNK characters comes in pieces, each with the offset of its first
    character; they overlap by least - 1 characters, so every window lies in exactly one of them.
    What is told of a window depends on its own characters alone, so a cut changes nothing.
    """
    held, n = [], 0

    def emit():
        codes = [np.append(np.frombuffer(t.encode("utf-32-le"), np.uint32), _SEP) for _, t, _ in held]
        firsts = np.cumsum([0, *(len(c) for c in codes)])
        return np.concatenate(codes), np.array([i for i, _, _ in held], np.int64), firsts, np.array([o for _, _, o in held], np.int64)

    for i, t in zip(ids, texts):
        if t is None or len(t) < least:
            continue
        for offset in range(0, len(t) - least + 1, CHUNK):
            piece = t[offset : offset + CHUNK + least - 1]
            if held and n + len(piece) > CHUNK:
                yield emit()
                held, n = [], 0
            held.append((i, piece, offset))
            n += len(piece)
    if held:
        yield emit()


_KEYS = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32()), ("last", pa.int32()), ("hot", pa.bool_())])


def _chains(doc: np.ndarray, key: np.ndarray, pos: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows to keep, their last position): three or more occurrences of a key that overlap or touch (a periodic text) become one row, from the first to the last."""
    order = np.lexsort((pos, key, doc))
    again = (np.diff(doc[order]) == 0) & (key[order][1:] == key[order][:-1]) & (np.diff(pos[order]) == 0)
    order = order[np.append(True, ~again)] if len(order) else order
    near = (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1]) & (np.diff(pos[order]) <= least)
    first = np.flatnonzero(np.append(True, ~near)) if len(order) else order
    size = np.diff(np.append(first, len(order)))
    head, times = np.repeat(first, size), np.repeat(size, size)
    rows = np.arange(len(order))
    keep = (times < 3) | (rows == head)
    last = pos[order][np.where(times < 3, rows, head + times - 1)]
    return order[keep], last[keep]


def _window_starts(firsts: np.ndarray, least: int) -> np.ndarray:
    """Where windows of `least` characters begin that lie inside one text of a chunk."""
    inside = np.ones(firsts[-1], bool)
    for end in firsts[1:]:
        inside[max(0, end - least) : end] = False
    return np.flatnonzero(inside)


def _find_keys(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            for codes, ids, firsts, offsets in _chunks(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), least):
                name, at = cores(codes, _window_starts(firsts, least), least)
                key = name.view(np.int64)
                row = np.searchsorted(firsts, at, side="right") - 1
                keep, last = _chains(row, key, at - firsts[row], least)
                start = offsets[row] - firsts[row]
                key, doc, pos, last = key[keep], ids[row[keep]], (at + start)[keep], last + offsets[row[keep]]
                uniq, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
                slot = uniq & (COUNTERS - 1)
                before = met[slot]
                met[slot] = before + times.astype(np.int32)
                hot = before + times > HOT_IN_TASK
                marks = uniq[hot & (before <= HOT_IN_TASK)]
                n = len(marks)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([key, marks])),
                        pa.array(np.concatenate([doc, np.full(n, -1)])),
                        pa.array(np.concatenate([pos, np.full(n, -1)]).astype(np.int32)),
                        pa.array(np.concatenate([last, np.full(n, -1)]).astype(np.int32)),
                        pa.array(np.concatenate([hot[inverse], np.zeros(n, bool)])),
                    ],
                    schema=_KEYS,
                )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a task, those whose key is in several documents (or hot somewhere)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    key, doc, pos, last, hot = (t[c].to_numpy() for c in ("key", "doc", "pos", "last", "hot"))
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(order) else order
    low, high = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
    several = np.empty(len(order), bool)
    several[order] = np.repeat(low < high, np.diff(np.append(first, len(order))))
    keep = (several | hot) & (pos >= 0)
    yield from pa.table({"key": key[keep], "doc": doc[keep], "pos": pos[keep], "last": last[keep]}).to_batches(max_chunksize=100_000)


_CONTEXT = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32()), ("text", pa.string()), ("before", pa.int32()), ("after", pa.int32())])


def _contexts(least: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, hits in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "hits"))):
                for h in hits:
                    p = h["pos"]
                    lo, hi = max(0, p - reach), min(len(text), p + least)
                    rows.append((h["key"], doc, p, text[lo:p].rjust(reach, "\0") + text[p:hi].ljust(least, "\0"), p - lo, hi - p))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CONTEXT)], schema=_CONTEXT)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CONTEXT)], schema=_CONTEXT)

    return run


def _run_length(equal: np.ndarray) -> np.ndarray:
    """Of each row, the number of leading True."""
    padded = np.concatenate([equal, np.zeros((len(equal), 1), bool)], axis=1)
    return padded.argmin(axis=1)


def _verify(least: int, reach: int):
    """Pairs of rows with the same key whose common stretch has `least` characters; rows come sorted by key."""

    def pairs(t: pa.Table) -> pa.Table:
        key, doc, pos = (t[c].to_numpy() for c in ("key", "doc", "pos"))
        before, after = t["before"].to_numpy(), t["after"].to_numpy()
        codes = np.frombuffer("".join(t["text"].to_pylist()).encode("utf-32-le"), np.uint32).reshape(len(key), -1)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        found = []
        for g in np.unique(size[size > 1]):
            i, j = np.triu_indices(g, 1)
            base = first[size == g][:, None]
            a, b = (base + i).ravel(), (base + j).ravel()
            other = doc[a] != doc[b]
            a, b = a[other], b[other]
            for k in range(0, len(a), 20_000):
                x, y = a[k : k + 20_000], b[k : k + 20_000]
                same = codes[x] == codes[y]
                left = np.minimum(_run_length(same[:, :reach][:, ::-1]), np.minimum(before[x], before[y]))
                right = np.minimum(_run_length(same[:, reach:]), np.minimum(after[x], after[y]))
                good = (right > 0) & (left + right >= least)
                x, y, left, n = x[good], y[good], left[good], (left + right)[good]
                found.append(np.stack([doc[x], pos[x] - left, doc[y], pos[y] - left, n]))
        out = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
        return pa.table(dict(zip(("doc_a", "start_a", "doc_b", "start_b", "n"), map(pa.array, out.astype(np.int64)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            last = int(np.searchsorted(t["key"].to_numpy(), t["key"][-1].as_py()))
            yield from pairs(t.slice(0, last).combine_chunks()).to_batches() if last else []
            rest = t.slice(last)
        if rest is not None:
            yield from pairs(rest.combine_chunks()).to_batches()

    return run


def _windows(least: int, reach: int):
    """The windows around each hit by their names: start of the first, stop of the last of those of a name that overlap or touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = {d: np.array([(h["pos"], h["last"]) for h in hits], np.int64) for d, hits in zip(batch.column("doc").to_pylist(), batch.column("hits").to_pylist())}
            for codes, ids, firsts, offsets in _chunks(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), least):
                hits = [places[i] for i in ids.tolist()]
                row = np.repeat(np.arange(len(ids)), [len(h) for h in hits])
                pos, last = (np.concatenate(hits) + (firsts[row] - offsets[row])[:, None]).T
                lo, hi = np.maximum(pos - reach, firsts[row]), np.minimum(last, firsts[row + 1] - 1 - least) + 1
                edges = np.bincount(lo[lo < hi], minlength=len(codes) + 2) - np.bincount(hi[lo < hi], minlength=len(codes) + 2)
                starts = np.flatnonzero(np.cumsum(edges))
                g1, g2 = window_names(codes, starts, least)
                doc = np.searchsorted(firsts, starts, side="right") - 1
                order = np.lexsort((starts, g2, g1, doc))
                g1, g2, starts, doc = g1[order], g2[order], starts[order], doc[order]
                new = (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(starts) > least)
                first = np.flatnonzero(np.append(True, new)) if len(starts) else starts
                stops = starts[np.append(first[1:], len(starts)) - 1] + least if len(starts) else starts
                begin = firsts[doc[first]] - offsets[doc[first]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g1[first], g2[first], ids[doc[first]], starts[first] - begin, stops - begin)], names=["g1", "g2", "doc", "start", "stop"])

    return run


def shared_spans(documents: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(copies, pairs, intervals) of texts that share a verbatim stretch of at least `least` characters.

    documents: doc_id (unique), text; texts under `least` characters and nulls share nothing.
    copies: doc, rep - each document with the smallest id that has the very same text; only the
    representatives are compared. pairs: value_a < value_b, representatives that share a stretch.
    intervals: doc, start, stop - stretches of a representative that stand in another one; their
    union is what it shares.

    No group is compared all against all: keys of more than PAIRWISE rows are split by their
    windows of `least` characters, whose groups are pairs of the result themselves. So are keys that
    repeat in a periodic stretch, such as a line of dashes: the stretch travels as one row and yields
    each of its windows once. A key that a task meets often goes to all tasks, by key and document.
    """
    if least < LEAST:
        raise ValueError(f"the rounds are laid out for at least {LEAST} characters")
    reach = least - CORE
    docs = documents.select(F.col("doc_id").alias("doc"), "text").filter(F.length("text") >= least)
    same = cut(docs.select("doc", F.sha2("text", 256).alias("sha"), F.length("text").alias("n_chars")))
    reps = same.groupBy("sha").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n"))
    several = cut(reps.filter("n > 1").select("sha", "rep"))
    copies = cut(same.join(several, "sha").select("doc", "rep")) if not several.isEmpty() else same.select("doc", F.col("doc").alias("rep")).limit(0)
    extra = copies.filter("doc <> rep").select("doc")
    n_extra = extra.count()
    if n_extra:
        flag = might_contain(docs, bloom_of(extra, F.col("doc"), n_extra), F.col("doc"))
        docs = docs.filter(~flag).unionByName(docs.filter(flag).join(extra, "doc", "left_anti"))
    chars = same.agg(F.sum("n_chars").alias("n")).first()["n"] or 0
    spark = documents.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(chars / 30 / 1_000_000) + 1)
    keys = docs.mapInArrow(_find_keys(least), "key bigint, doc bigint, pos int, last int, hot boolean")
    spread = F.when(F.col("hot"), F.xxhash64("key", "doc")).otherwise(F.xxhash64("key"))
    hits = cut(keys.repartition(tasks, spread).mapInArrow(_shared, "key bigint, doc bigint, pos int, last int"))
    sizes = hits.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("last") > F.col("pos")).alias("periodic"))
    large = cut(sizes.filter((F.col("rows") > PAIRWISE) | F.col("periodic")).select("key"))
    n_large = large.count()
    if n_large:
        flag = might_contain(hits, bloom_of(large, F.col("key"), n_large), F.col("key"))
        maybe = hits.filter(flag).join(large.withColumn("is_large", F.lit(True)), "key", "left")
        marked = hits.filter(~flag).withColumn("is_large", F.lit(None).cast("boolean")).unionByName(maybe)
    else:
        marked = hits.withColumn("is_large", F.lit(None).cast("boolean"))
    pick = lambda big: F.filter("hits", lambda h: h["is_large"].isNotNull() if big else h["is_large"].isNull())
    by_doc = cut(marked.groupBy("doc").agg(F.collect_list(F.struct("key", "pos", "last", "is_large")).alias("hits")))
    n_docs = by_doc.count()
    wanted = docs.filter(might_contain(docs, bloom_of(by_doc, F.col("doc"), n_docs), F.col("doc"))).join(by_doc, "doc")
    kind = "key bigint, doc bigint, pos int, text string, before int, after int"
    small = wanted.select("doc", "text", pick(False).alias("hits")).filter(F.size("hits") > 0).mapInArrow(_contexts(least, reach), kind)
    rows = "doc_a bigint, start_a bigint, doc_b bigint, start_b bigint, n bigint"
    verified = cut(small.repartition("key").sortWithinPartitions("key").mapInArrow(_verify(least, reach), rows))
    ordered = [F.least("doc_a", "doc_b").alias("value_a"), F.greatest("doc_a", "doc_b").alias("value_b")]
    pairs = verified.select(*ordered).distinct()
    intervals = verified.select(F.col("doc_a").alias("doc"), F.col("start_a").alias("start"), (F.col("start_a") + F.col("n")).alias("stop")).unionByName(
        verified.select(F.col("doc_b").alias("doc"), F.col("start_b").alias("start"), (F.col("start_b") + F.col("n")).alias("stop"))
    )
    if n_large:
        grams = wanted.select("doc", "text", pick(True).alias("hits")).filter(F.size("hits") > 0).mapInArrow(_windows(least, reach), "g1 bigint, g2 bigint, doc bigint, start bigint, stop bigint")
        grams = cut(grams)
        groups = grams.groupBy("g1", "g2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").drop("lo", "hi")
        met = cut(grams.join(groups, ["g1", "g2"]))
        # one window for each set of documents: neighbouring windows mostly stand in the same ones
        sets = met.groupBy("g1", "g2").agg(F.bit_xor(F.xxhash64("doc")).alias("x"), F.sum(F.shiftright(F.xxhash64("doc", F.lit(1)), 32)).alias("y"), F.count(F.lit(1)).alias("n"))
        chosen = sets.groupBy("x", "y", "n").agg(F.min(F.struct("g1", "g2")).alias("g")).select("g.g1", "g.g2")
        members = met.join(chosen, ["g1", "g2"]).groupBy("doc", "g1", "g2").agg(F.min("start").alias("start"))
        members = cut(members.groupBy("doc").agg(F.collect_list(F.struct("g1", "g2", "start")).alias("m")))
        asked = docs.filter(might_contain(docs, bloom_of(members, F.col("doc"), members.count()), F.col("doc")))
        texts = asked.join(members, "doc").select("doc", "text", F.explode("m").alias("m"))
        shown = cut(texts.select("doc", "m.g1", "m.g2", F.sha2(F.substring("text", F.col("m.start").cast("int") + 1, F.lit(least)), 256).alias("window")))
        on = ["g1", "g2", "window"]
        more = shown.withColumnRenamed("doc", "value_a").join(shown.withColumnRenamed("doc", "value_b"), on).filter("value_a < value_b").select("value_a", "value_b")
        pairs = pairs.unionByName(more).distinct()
        intervals = intervals.unionByName(met.select("doc", "start", "stop"))
    return copies, pairs, intervals


def expand_pairs(copies: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b: pairs of documents instead of representatives, and the copies among themselves."""
    alone = pairs.select(F.col("value_a").alias("id")).union(pairs.select("value_b")).distinct().withColumn("value", F.col("id"))
    members = alone.unionByName(copies.select(F.col("doc").alias("id"), F.col("rep").alias("value"))).distinct()
    reps = copies.select(F.col("rep").alias("value_a"), F.col("rep").alias("value_b")).distinct()
    members = cut(members)
    both = expand(pairs.unionByName(reps), members, members, members.count()).filter("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shared_classes(documents: DataFrame, copies: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, class_id, links: for each document its class of the very same text, and how many others it shares a stretch with.

    class_id is the smallest id of the class; copies in a class share all of their text. The links
    are counted over classes, so they are never written out pair by pair.
    """
    sizes = copies.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.col("value_a").alias("rep"), F.col("value_b").alias("other")).unionByName(pairs.select(F.col("value_b").alias("rep"), F.col("value_a").alias("other")))
    others = sides.join(sizes.withColumnRenamed("rep", "other"), "other", "left").groupBy("rep").agg(F.sum(F.coalesce("n", F.lit(1))).alias("linked"))
    docs = documents.select(F.col("doc_id").alias("doc")).join(copies, "doc", "left").withColumn("rep", F.coalesce("rep", "doc"))
    known = docs.join(sizes, "rep", "left").join(others, "rep", "left")
    return known.select(F.col("doc").alias("doc_id"), F.col("rep").alias("class_id"), (F.coalesce("linked", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("links"))


def shared_chars(documents: DataFrame, copies: DataFrame, intervals: DataFrame) -> DataFrame:
    """doc_id, n_chars, shared: for each document how many of its characters stand elsewhere, too."""
    from pyspark.sql import Window

    spans = intervals.groupBy("doc", "start").agg(F.max("stop").alias("stop"))
    before = F.max("stop").over(Window.partitionBy("doc").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("from", F.greatest("start", F.coalesce(before, F.lit(0)))).withColumn("n", F.greatest(F.col("stop") - F.col("from"), F.lit(0)))
    covered = new.groupBy("doc").agg(F.sum("n").alias("covered"))
    docs = documents.select(F.col("doc_id").alias("doc"), F.length("text").alias("n_chars"))
    joined = docs.join(covered, "doc", "left").join(copies.select("doc", "rep"), "doc", "left")
    shared = F.when(F.col("rep").isNotNull(), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return joined.select(F.col("doc").alias("doc_id"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.coalesce(shared, F.lit(0)).cast("bigint").alias("shared"))
