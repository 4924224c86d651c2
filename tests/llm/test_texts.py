"""Tokens, packing, mixing and shared spans against brute force on small inputs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from notegraph.llm import packing as P
from notegraph.llm import shared_spans as S
from notegraph.llm import text_queries
from notegraph.llm.mixing import mix, plan, schedule
from notegraph.llm.tokens import FOLDER, NAME, token_count, words

# ---- tokens


def test_token_counts_are_those_of_the_tokenizer(spark):
    counter = words(FOLDER, NAME)
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(" \n\tab1.é가'sX　\u0085") for _ in range(rnd.randint(0, 15))) for _ in range(3000)]
    texts += ["", "a", "  ", "don't  stop\n\n\nnow ", "한글 문장입니다. 그리고\n\n또", "x" * 5000, " ", "\n x"]
    for t in texts:
        assert counter.count(t) == len(counter.encode(t)), repr(t)
    df = spark.createDataFrame([(t,) for t in texts[-8:]] + [(None,)], "t string")
    assert [r[0] for r in df.select(token_count(F.col("t"))).collect()] == [*(len(counter.encode(t)) for t in texts[-8:]), 0]


# ---- packing


@pytest.mark.parametrize("seed", range(6))
def test_pack(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([0, rnd.randint(1, 100), rnd.randint(30, 60)]) for _ in range(rnd.choice([0, 1, 7, 60, 400]))]
    bins, limited = P.pack(sizes, 100)
    assert not limited
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len([b for b in bins if any(sizes[i] for i in b)]) <= len(P.best_fit([s for s in sizes if s], 100))


@pytest.mark.parametrize("sizes", [[1] * 20_000, [1] * 15_000 + [2] * 5_000, [3] * 9_000 + list(range(4, 400))])
def test_pack_many_tiny_items(sizes):
    bins, limited = P.pack(sizes, 4096)
    assert not limited
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 4096 for b in bins)
    assert len(bins) == -(-sum(sizes) // 4096)


def least_bins(sizes, capacity):
    """Fewest containers, by search."""
    best = len(sizes)

    def walk(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                walk(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        walk(i + 1, [*bins, sizes[i]])

    walk(0, [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_branch_and_bound_is_optimal_on_small_inputs(seed):
    rnd = random.Random(seed)
    sizes = sorted((rnd.randint(15, 70) for _ in range(11)), reverse=True)
    bins, limited = P.branch_and_bound(sizes, 100)
    assert len(bins) == least_bins(sizes, 100) and not limited


@pytest.mark.parametrize("capacity", [100, 1000, 4096])
def test_triplets_are_packed_into_full_containers(capacity):
    """60 items that fill 20 containers exactly, three by three: hard for any greedy packing."""
    for seed in range(20):
        rnd = random.Random(seed)
        sizes = []
        for _ in range(20):
            a = rnd.randint(capacity * 38 // 100, capacity * 49 // 100)
            b = rnd.randint((capacity - a) // 2 - (capacity - a) // 8, (capacity - a) // 2)
            sizes += [a, b, capacity - a - b]
        rnd.shuffle(sizes)
        bins, limited = P.pack(sizes, capacity)
        assert len(bins) == 20 and not limited and sorted(i for b in bins for i in b) == list(range(60))


def test_a_search_that_is_cut_short_says_so():
    sizes = [51, 27, 26, 23] * 12 + [35, 34, 33] * 7
    bins, limited = P.branch_and_bound(sizes, 100, nodes=0)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert limited or len(bins) == -(-sum(sizes) // 100)


def test_all_undominated_fillings_come_fullest_first():
    from itertools import combinations

    rest, first, capacity = [29, 27, 26, 25, 23, 22, 20, 19, 17, 16, 14, 13, 11, 7, 5], 20, 120
    want, space = set(), capacity - first
    for n in range(len(rest) + 1):
        for taken in combinations(rest, n):
            left, out = space - sum(taken), [o for o in rest if o not in taken]
            sums = [*taken, *(a + b for a, b in combinations(taken, 2))]
            same = lambda s, o: o == s and s in taken  # noqa: E731, B023
            if left >= 0 and not any(o <= left for o in out) and not any(s <= o <= s + left and not same(s, o) for s in sums for o in out):
                want.add(tuple(sorted(taken)))
    values = sorted(rest)
    got = [tuple(sorted(f)) for f in P.undominated(space, values, dict.fromkeys(values, 1))]
    sums = [sum(f) for f in got]
    assert len(want) > 50 and set(got) == want and len(got) == len(want) and sums == sorted(sums, reverse=True)


def test_containers(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([rnd.randint(1, 60), 100, 250, 0])) for i in range(300)] + [(900, None), (901, -5)]
    df = spark.createDataFrame(rows, "id bigint, size bigint").withColumn("piece", F.lit("clash"))
    got = P.fill_containers(df, 100, group_items=60).collect()
    fill, size = Counter(), Counter()
    for r in got:
        fill[r["container"]] += r["size"]
        size[r["id"]] += r["size"]
        assert r["size"] == 100 or r["piece"] == max(x["piece"] for x in got if x["id"] == r["id"])
    assert max(fill.values()) <= 100
    assert {i: size[i] for i, _ in rows} == {i: max(s or 0, 0) for i, s in rows}
    assert all(len([r for r in got if r["id"] == i]) == max(1, -(-s // 100)) for i, s in rows if s and s > 0)
    least = -(-sum(size.values()) // 100)
    assert len(fill) <= least + 2
    report = P.fill_report(P.fill_containers(df.limit(0), 100), 100).first()
    assert (report["containers"], report["size"]) == (0, 0)


# ---- mixing


def test_schedule_keeps_every_source_within_a_block():
    rnd = random.Random(6)
    for _ in range(20):
        blocks = [rnd.randint(0, 40) for _ in range(rnd.randint(1, 9))]
        order = schedule([b * 10 for b in blocks], 10)
        assert Counter(s for s, _ in order) == {i: b for i, b in enumerate(blocks) if b}
        got = [0] * len(blocks)
        for t, (s, j) in enumerate(order, 1):
            assert j == got[s]
            got[s] += 1
            assert all(abs(b * t / sum(blocks) - g) < 1 for b, g in zip(blocks, got))


def test_plan():
    rows = {r["source"]: r for r in plan({"a": 100, "b": 10}, [("a", 0.5, 1), ("b", 0.3, 4), ("none", 0.2, 3)])}
    assert (rows["a"]["quota"], rows["b"]["quota"], rows["none"]["quota"]) == (66, 39, 0)
    short = {r["source"]: r for r in plan({"a": 100, "b": 10}, [("a", 0.5, 1), ("b", 0.5, 2)], size=80)}
    assert (short["a"]["quota"], short["b"]["quota"], short["b"]["target"]) == (40, 20, 40)
    assert plan({}, [("a", 0.5, 1)])[0]["quota"] == 0


def test_mix(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["a", "a", "a", "b", "other", None]), rnd.choice([rnd.randint(1, 30), 0, None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint").withColumn("weight", F.lit(1))
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 3), ("gone", 0.1, 2), (None, 0.1, 1)], "source string, weight double, max_repeat int")
    selection, shares = mix(docs, targets, block=50)
    got, sizes = selection.collect(), {i: s for i, _, s in rows}
    uses = Counter(r["doc_id"] for r in got)
    source = {i: s for i, s, _ in rows}
    assert all(n <= {"a": 1, "b": 3}[source[i]] for i, n in uses.items())
    assert all(r["size"] == sizes[r["doc_id"]] > 0 for r in got)
    assert len({(r["doc_id"], r["pass"]) for r in got}) == len(got)
    by = {r["source"]: r for r in shares.collect()}
    for s in ("a", "b"):
        assert abs(by[s]["short"]) <= 15
        assert by[s]["size"] == sum(r["size"] for r in got if r["source"] == s)
    assert abs(by["a"]["share"] - 2 / 3) < 0.02 and by["gone"]["size"] == 0
    empty, none = mix(docs.limit(0), targets)
    assert empty.count() == 0 and {r["size"] for r in none.collect()} == {0}
    assert mix(docs, targets.limit(0))[1].count() == 0


@pytest.mark.parametrize("slots", [100_000, 90, 25, 7])
def test_lag_is_that_of_the_emitted_documents(spark, slots, monkeypatch):
    """Documents longer than a block: the lag counts their overhang, as a plain walk over the rows does; in one epoch or many."""
    monkeypatch.setattr("notegraph.llm.mixing.MAX_SLOTS", slots)
    rnd = random.Random(18)
    rows = [(i, "ab"[i % 2], rnd.randint(1, 200)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 2), ("gone", 0.2, 1)], "source string, weight double, max_repeat int")
    selection, shares = mix(docs, targets, block=50)
    by = {r["source"]: r for r in shares.collect()}
    per_slot = Counter()
    ordered = selection.orderBy("slot", "at").collect()
    for k in "ab":  # each source in the order of its stream, in blocks of 50 tokens whatever the number of epochs
        own = [r["at"] for r in ordered if r["source"] == k]
        assert own == sorted(own) and len({r["slot"] for r in ordered if r["source"] == k}) > 0.4 * len(own)
    for r in ordered:
        per_slot[(r["slot"], r["source"])] += r["size"]
    quota = {"a": by["a"]["target"], "b": by["b"]["target"]}
    total, got, worst = 0, Counter(), Counter()
    for (_, s), n in sorted(per_slot.items()):
        total += n
        got[s] += n
        for k, q in quota.items():
            worst[k] = max(worst[k], abs(total * q / sum(quota.values()) - got[k]) / 50)
    for k in quota:
        assert by[k]["lag"] == pytest.approx(worst[k]) and 1 < by[k]["lag"] < 2 + 200 / 50
    assert by["gone"]["lag"] == 0


def test_mix_of_all_tokens(spark, tmp_path):
    texts = [(i, "large" if i else "small", " ".join(f"word{i}" for _ in range(20))) for i in range(60)]
    spark.createDataFrame(texts, "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("large", 0.7, 1), ("small", 0.3, 2)], "source string, weight double, max_repeat int").write.parquet(f"{tmp_path}/mix_target.parquet")
    few, got = (text_queries.QUERIES[q](spark, str(tmp_path)).collect() for q in ("p8_mix", "p8_all_mix"))
    by = {r["source"]: r for r in text_queries.QUERIES["p8_all_tokens"](spark, str(tmp_path)).collect()}
    assert Counter(r["source"] for r in got)["small"] == 2 and len(got) > 40 > 5 * len(few) / 2
    for s in ("large", "small"):
        assert by[s]["tokens"] == sum(r["tokens"] for r in got if r["source"] == s)
    assert by["small"]["short"] > by["small"]["tokens"] and abs(by["large"]["short"]) < 100


# ---- shared spans


def brute(docs, least=200):
    from collections import defaultdict
    from itertools import combinations

    grams = defaultdict(set)
    for i, t in docs:
        for k in range(len(t or "") - least + 1):
            grams[t[k : k + least]].add(i)
    pairs = {p for s in grams.values() if len(s) > 1 for p in combinations(sorted(s), 2)}
    cover = {}
    for i, t in docs:
        hit = bytearray(len(t or ""))
        for k in range(len(t or "") - least + 1):
            if len(grams[t[k : k + least]]) > 1:
                hit[k : k + least] = b"\1" * least
        cover[i] = sum(hit)
    return pairs, cover


def corpus(seed, alphabet, n=60):
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice(alphabet) for _ in range(k))
    stock = [word(rnd.choice([150, 199, 200, 201, 240, 500])) for _ in range(6)]
    docs = []
    for i in range(n):
        t = word(rnd.randint(0, 300))
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(stock)
            a = rnd.randint(0, max(0, len(s) - 199))
            t += s[a : a + rnd.choice([len(s), 199, 200, 230])] + word(rnd.randint(1, 80))
        docs.append((i, t))
    return [*docs, (1000, docs[3][1]), (1001, docs[3][1]), (1002, docs[4][1] + "x"), (1003, ""), (1004, None), (1005, "short")]


@pytest.mark.parametrize("seed,alphabet", [(1, "abcdefgh  ."), (2, "ab"), (3, "가나다라마é 😀x")])
def test_shared_spans(spark, seed, alphabet, monkeypatch):
    docs = corpus(seed, alphabet)
    want, cover = brute(docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("key", F.lit(1))
    copies, pairs, intervals = S.shared_spans(df)
    assert {tuple(r) for r in S.expand_pairs(copies, pairs).collect()} == want
    got = {r["doc_id"]: r["shared"] for r in S.shared_chars(df, copies, intervals).collect()}
    assert got == cover
    links = {r["doc_id"]: (r["class_id"], r["links"]) for r in S.shared_classes(df, copies, pairs).collect()}
    first = {t: min(i for i, u in docs if u == t) for _, t in docs}
    assert links == {i: (first[t] if t and len(t) >= 200 else i, sum(i in p for p in want)) for i, t in docs}


def test_long_texts_come_in_pieces(spark, monkeypatch):
    """Pieces of 300 characters give what whole texts give, by pairs, by windows and in periodic stretches."""
    docs = corpus(21, "abcdef ")
    docs += [(2000, "x" + "ab" * 700 + docs[5][1]), (2001, docs[5][1] + "ab" * 500), (2002, "".join(t or "" for _, t in docs[:20]))]
    want, cover = brute(docs)
    for pairwise in (32, 3):
        monkeypatch.setattr(S, "PAIRWISE", pairwise)
        monkeypatch.setattr(S, "_find_keys", _with_chunk(300, S._find_keys))
        monkeypatch.setattr(S, "_windows", _with_chunk(300, S._windows))
        df = spark.createDataFrame(docs, "doc_id bigint, text string")
        copies, pairs, intervals = S.shared_spans(df)
        assert {tuple(r) for r in S.expand_pairs(copies, pairs).collect()} == want
        assert {r["doc_id"]: r["shared"] for r in S.shared_chars(df, copies, intervals).collect()} == cover
        monkeypatch.undo()


def _with_chunk(size, make):
    """`make`, whose function sets CHUNK where it runs, in the worker."""

    def made(*args):
        run = make(*args)

        def inside(batches):
            from notegraph.llm import shared_spans

            before, shared_spans.CHUNK = shared_spans.CHUNK, size
            try:
                yield from run(batches)
            finally:
                shared_spans.CHUNK = before

        return inside

    return made


def test_hot_groups_are_split_by_grams(spark, monkeypatch):
    monkeypatch.setattr(S, "PAIRWISE", 4)
    docs = corpus(9, "abcdef ")
    want, cover = brute(docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    copies, pairs, intervals = S.shared_spans(df)
    assert {tuple(r) for r in S.expand_pairs(copies, pairs).collect()} == want
    assert {r["doc_id"]: r["shared"] for r in S.shared_chars(df, copies, intervals).collect()} == cover


def test_periodic_texts(spark):
    rnd = random.Random(11)
    word = lambda k: "".join(rnd.choice("abcdefgh") for _ in range(k))
    docs = []
    for i, unit in enumerate(["-", "ab", "abc|", "-" * 30 + "\n"]):
        tail = word(40)
        docs += [(10 * i, word(50) + unit * 300 + tail), (10 * i + 1, word(30) + unit * (250 // len(unit)) + tail + word(20)), (10 * i + 2, unit * (199 // len(unit)) + "zz" + word(100)), (10 * i + 3, word(9) + unit * (190 // len(unit)) + tail)]
    want, _ = brute(docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    copies, pairs, _ = S.shared_spans(df)
    assert {tuple(r) for r in S.expand_pairs(copies, pairs).collect()} == want


def test_periodic_texts_of_other_phases(spark):
    rnd = random.Random(13)
    word = lambda k: "".join(rnd.choice("abcdefgh") for _ in range(k))
    docs = []
    for size in (20, 33, 40, 47, 57, 64, 80, 100):
        line = word(size) * 30
        for n in (416, 205, 230, 330, 1200, 199, 210, 275):
            at = rnd.randrange(size)
            docs.append((len(docs), word(rnd.randint(0, 70)) + "Z" + line[at : at + n] + "Y" + word(rnd.randint(0, 70))))
    want, cover = brute(docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    copies, pairs, intervals = S.shared_spans(df)
    assert {tuple(r) for r in S.expand_pairs(copies, pairs).collect()} == want
    assert {r["doc_id"]: r["shared"] for r in S.shared_chars(df, copies, intervals).collect()} == cover


def test_nothing_shared(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    copies, pairs, intervals = S.shared_spans(df)
    assert pairs.count() == 0 and S.expand_pairs(copies, pairs).count() == 0
    assert {tuple(r) for r in S.shared_chars(df, copies, intervals).collect()} == {(1, 1, 0), (2, 0, 0)}
    assert S.shared_spans(df.limit(0))[1].count() == 0


def test_hot_keys_in_a_chunk_and_long_texts(spark):
    rnd = random.Random(12)
    word = lambda k: "".join(rnd.choice("abcdefgh ") for _ in range(k))
    stock = word(260)
    docs = [(i, word(rnd.randint(0, 60)) + stock[: 200 + i % 60] + word(30)) for i in range(90)]
    end = word(300)
    docs += [(500, word(1_100_000) + end), (501, end + word(50)), (502, word(400))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    copies, pairs, intervals = S.shared_spans(df)
    want = {(a, b) for a in range(90) for b in range(a + 1, 90)} | {(500, 501)}
    assert {tuple(r) for r in S.expand_pairs(copies, pairs).collect()} == want
    got = {r["doc_id"]: r["shared"] for r in S.shared_chars(df, copies, intervals).collect()}
    assert (got[500], got[501], got[502]) == (300, 300, 0)


def _codes(text):
    return np.frombuffer((text + "\U0010ffff").encode("utf-32-le"), np.uint32)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij", "a" * 6 + "b", "a"])
def test_equal_windows_have_equal_cores_and_names(alphabet):
    rnd = random.Random(13)
    word = lambda k: "".join(rnd.choice(alphabet) for _ in range(k))
    for _ in range(20):
        same = rnd.choice([word(S.LEAST), (word(rnd.randint(1, 90)) * S.LEAST)[: S.LEAST]])
        core, named = set(), set()
        for _ in range(3):
            before = word(rnd.randint(0, 300))
            codes = _codes(before + same + word(rnd.randint(0, 300)))
            name, at = S.cores(codes, np.array([len(before)]))
            core.add((int(name[0]), int(at[0]) - len(before)))
            named.add(tuple(int(x[0]) for x in S.window_names(codes, np.array([len(before)]))))
        assert len(core) == 1 and len(named) == 1 and 0 <= core.pop()[1] <= S.LEAST - S.CORE


def test_different_windows_have_different_names():
    rnd = random.Random(15)
    for unit in ("ab", "abcdefghij", "a" * 30 + "b"):
        text = "".join(rnd.choice(unit) for _ in range(3000)) + unit * 60
        starts = np.arange(len(text) - S.LEAST + 1)
        names = list(zip(*(x.tolist() for x in S.window_names(_codes(text), starts))))
        assert len(set(names)) == len({text[i : i + S.LEAST] for i in starts})
        assert len({text[i : i + S.LEAST] for i in starts}) == len(dict(zip(names, (text[i : i + S.LEAST] for i in starts))))


def test_planted_periodic_pairs(spark):
    """600 pairs of texts with a shared periodic run, each of an alphabet of its own."""
    rnd = random.Random(14)
    docs, want = [], set()
    for k in range(600):
        letters = [chr(0x4E00 + 12 * k + j) for j in range(12)]
        word = lambda n: "".join(rnd.choice(letters[:8]) for _ in range(n))  # noqa: E731, B023
        unit = "".join(rnd.choice(letters[8:]) for _ in range(rnd.randint(1, 8)))
        for j, n in enumerate((rnd.choice([200, 220, 300, 3000]), rnd.choice([200, 207, 1000, 3000]))):
            docs.append((2 * k + j, word(rnd.randint(0, 40)) + (unit * 3000)[:n] + word(rnd.randint(0, 40))))
        want.add((2 * k, 2 * k + 1))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    copies, pairs, intervals = S.shared_spans(df)
    assert {tuple(r) for r in S.expand_pairs(copies, pairs).collect()} == want
    got = {r["doc_id"]: r["shared"] for r in S.shared_chars(df, copies, intervals).collect()}
    text = dict(docs)
    assert all(got[i] >= 200 for i in text)
    for a, b in want:
        if len(text[a]) > 3000 and len(text[b]) > 3000:
            assert got[a] >= 3000 and got[b] >= 3000


def test_a_phrase_in_all_documents_goes_to_all_tasks(spark, monkeypatch):
    """Its rows beyond HOT_IN_TASK of each task are spread; all pairs are found nonetheless."""
    rnd = random.Random(16)
    word = lambda k: "".join(rnd.choice("abcdefgh ") for _ in range(k))
    phrase = word(260)
    docs = [(i, word(300) + phrase + word(300)) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    keys = df.select(F.col("doc_id").alias("doc"), "text").mapInArrow(S._find_keys(S.LEAST), "key bigint, doc bigint, pos int, last int, hot boolean").collect()
    per_key = Counter(r["key"] for r in keys if r["pos"] >= 0)
    key, n = per_key.most_common(1)[0]
    assert n == 120 and sum(r["hot"] for r in keys if r["key"] == key) >= 120 - 2 * S.HOT_IN_TASK
    assert sum(r["key"] == key and r["pos"] < 0 for r in keys) == 2
    copies, pairs, intervals = S.shared_spans(df)
    assert S.expand_pairs(copies, pairs).count() == 120 * 119 // 2
    assert {r["shared"] >= 260 for r in S.shared_chars(df, copies, intervals).collect()} == {True}
