"""Pairs, canonical values, look-alikes and term counts against brute force on small inputs."""

import itertools
import math
import random
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from notegraph.functions.looks import looks
from notegraph.llm import cooccurrence as C
from notegraph.llm.canonical import canonical_rows, canonical_values
from notegraph.llm.graph_text import p5_found
from notegraph.llm.lookalikes import consistent_forms
from notegraph.llm.tags import tag_form
from notegraph.llm import term_counts as T
from notegraph.llm.term_counts import marks, term_counts


def pair_counts(rows):
    by = defaultdict(set)
    for r, i in rows:
        if r is not None and i is not None:
            by[r].add(i)
    return Counter(p for s in by.values() for p in itertools.combinations(sorted(s), 2)), Counter(i for s in by.values() for i in s), len(by)


@pytest.mark.parametrize("max_basket,min_count", [(2000, 1), (8, 1), (8, 4)])
def test_pairs(spark, max_basket, min_count, monkeypatch):
    monkeypatch.setattr(C, "MAX_BASKET", max_basket)
    monkeypatch.setattr(C.baskets, "__defaults__", (max_basket, None))
    rnd = random.Random(3)
    rows = [(f"r{rnd.randrange(60)}", f"t{min(rnd.randrange(40), rnd.randrange(40))}") for _ in range(600)]
    rows += [("big", f"t{i}") for i in range(40)] + [(None, "x"), ("r1", None), ("r1", ""), ("r1", "한")] + rows[:20]
    want, single, total = pair_counts(rows)
    df = spark.createDataFrame(rows, "r string, i string")
    got = {(r["item_a"], r["item_b"]): r for r in C.cooccurrence(df, "r", "i", min_count).collect()}
    assert {k: r["n"] for k, r in got.items()} == {k: n for k, n in want.items() if n >= min_count}
    for (a, b), r in got.items():
        assert (r["n_a"], r["n_b"], r["total"]) == (single[a], single[b], total)
        assert math.isclose(r["lift"], r["n"] * total / (single[a] * single[b]))
        assert r["llr"] >= -1e-9


def test_long_stripes_travel_in_parts(spark, monkeypatch):
    """An item in every record: no task gets more than a part of its cells, and the counts stay right."""
    monkeypatch.setattr(C, "LONG_STRIPE", 20)
    monkeypatch.setattr(C, "LEAST_PARTS", 16)
    rnd = random.Random(4)
    rows = [(f"r{k}", i) for k in range(150) for i in {"hub", *(f"t{rnd.randrange(300)}" for _ in range(8))}]
    want, _, _ = pair_counts(rows)
    df = spark.createDataFrame(rows, "r string, i string").repartition(3)
    got = {(r["item_a"], r["item_b"]): r["n"] for r in C.cooccurrence(df, "r", "i").collect()}
    assert got == dict(want)
    stripes = C.baskets(df.select(F.col("r").alias("record"), F.col("i").alias("item"))).mapInArrow(C._stripes(16), C._SCHEMA).collect()
    cells = Counter()
    for r in stripes:
        cells[(r["item"], r["part"])] += len(r["neighbours"])
    hub = [n for (i, _), n in cells.items() if i == "hub"]
    assert len(hub) == 16 and max(hub) < 0.2 * sum(hub)


def test_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "r string, i string")
    assert C.cooccurrence(df, "r", "i").count() == 0
    assert C.cooccurrence(df, "r", "i", 5, 0.1).count() == 0


def test_tag_form(spark):
    df = spark.createDataFrame([(" #Ab/C ",), ("ab/c",), ("##x",), ("# y",), (None,), ("ÉA ",)], "t string")
    assert [r[0] for r in df.select(tag_form(F.col("t"))).collect()] == ["ab/c", "ab/c", "#x", "y", None, "éa"]


# ---- canonical values

NAMES = [("concept", ["notion", "개념"]), ("log", ["journal"]), ("hub", ["map of content"]), ("case", ["incident"]), ("source-note", None), (None, ["x"])]


def slips(a, b):
    """Damerau-Levenshtein with neighbours that may be edited again, by search over words."""
    if abs(len(a) - len(b)) > 2:
        return 9
    letters = set(a + b)

    def one(w):
        out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        return out | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}

    if a == b:
        return 0
    first = one(a)
    if b in first:
        return 1
    return 2 if first & one(b) else 9


def letters_only(s):
    return "".join(c for c in s.lower() if c.isalpha() or c.isdigit())


def canonical(value):
    best = []
    for entry, also in NAMES:
        for name in [entry, *(also or [])] if entry else []:
            f = letters_only(name)
            k = 0 if len(f) < 4 else 1 if len(f) < 7 else 2
            n = slips(letters_only(value), f)
            if n <= k:
                best.append((n, entry))
    return min(best)[1] if best else "?"


def test_canonical_values(spark):
    rnd = random.Random(5)
    values = {"Concept", "#log", "lgo", "", "  ", "log", "hub ", "???", "개념", "개렴", "casee", "caes", "acse", "no such", "MAP-of_content", "mapofcnotetn", "tnoecpc"}
    for _ in range(250):
        w = letters_only(rnd.choice([n for e, a in NAMES if e for n in [e, *(a or [])]]))
        for _ in range(rnd.randint(0, 3)):
            i, kind = rnd.randrange(len(w) + 1), rnd.randrange(4)
            w = [w[:i] + "z" + w[i:], w[:i] + w[i + 1 :], w[:i] + "q" + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]][kind]
        values.add(w)
    ref = spark.createDataFrame(NAMES, "entry string, also array<string>")
    df = spark.createDataFrame([(v,) for v in values] + [(None,), ("Concept",)], "value string")
    got = {r["value"]: r["entry"] for r in canonical_values(df, ref).collect()}
    entries = {e for e, _ in NAMES}
    assert got == {v: canonical(v) for v in values if v.strip() and v not in entries}


def test_canonical_rows_and_empty(spark):
    ref = spark.createDataFrame(NAMES, "entry string, also array<string>")
    rows = spark.createDataFrame([(1, "Log", "x"), (1, "Log", "y"), (2, "nope", "x"), (3, None, "x"), (4, "log", "x")], "id int, t string, entry string")
    assert sorted(tuple(r) for r in canonical_rows(rows, "id", "t", ref).collect()) == [(1, "log"), (2, "?")]
    assert sorted(tuple(r) for r in canonical_rows(rows, "id", "t", ref.limit(0)).collect()) == [(1, "?"), (2, "?"), (4, "?")]
    assert canonical_rows(rows.limit(0), "id", "t", ref).count() == 0


# ---- look-alikes


def test_p5_against_brute_force(spark, tmp_path):
    f = looks(spark).form
    node = [(1, "a/Flow.md", "Flow"), (2, "b/Ｆlow.md", "Ｆlow"), (3, "c/flow.md", "flow"), (4, "ａ/Flow.md", "Flow"), (5, "d/Узел.md", "Узел"), (2, "b/Ｆlow.md", "Ｆlow"), (6, "e/x.md", None), (7, "a/F​low.md", "F​low")]
    edge = [(101, "Flow|x"), (101, "Flow|x"), (102, "Узeл"), (103, "a/Flow"), (104, "ａ/Ｆlow#h"), (105, "flow"), (106, ""), (107, "d/Узeл^1")]
    spark.createDataFrame(node, "node_id bigint, path string, name string").write.parquet(f"{tmp_path}/node.parquet")
    spark.createDataFrame(edge, "edge_id bigint, raw string").write.parquet(f"{tmp_path}/edge.parquet")
    want = set()
    nodes, stem = set(node), lambda p: p.removesuffix(".md")
    for a, b in itertools.permutations(nodes, 2):
        for k in (1, 2):
            if a[0] < b[0] and a[k] and b[k] and a[k] != b[k] and f(a[k]) == f(b[k]):
                want.add((a[0], b[0]))
    for n in nodes:
        for i, raw in edge:
            cut = raw.split("|")[0].split("#")[0].split("^")[0].strip()
            own = stem(n[1]) if "/" in cut else n[2]
            if own is not None and own != cut and f(own) == f(cut):
                want.add((n[0], i))
    got = [tuple(r) for r in p5_found(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_consistent_forms(spark):
    df = spark.createDataFrame([("Узeл", 1), ("Узeл", 1), (None, 2), ("", 3), ("ab", 4)], "value string, form int")
    got = {r["value"]: (r["form"], r["kind"]) for r in consistent_forms(df).collect()}
    assert got == {"Узeл": ("Узел", "mixed-script"), "": ("", "none"), "ab": ("ab", "none")}


# ---- term counts


@pytest.mark.parametrize("leaf_rows", [500_000, 40])
def test_term_counts(spark, leaf_rows):
    rnd = random.Random(7)
    day = lambda d: datetime(2024, 1, d)
    rows = [(f"r{rnd.randrange(80)}", "hot" if rnd.random() < 0.4 else f"t{rnd.randrange(60)}", f"raw{rnd.randrange(3)}", day(rnd.randint(1, 4))) for _ in range(900)]
    rows += rows[:100] + [("r1", None, "x", day(1)), (None, "lost", "x", day(1)), ("r1", "", "", None), ("r1", "", "", None)]
    df = spark.createDataFrame(rows, "record string, term string, raw string, at timestamp_ntz")
    uniq = {r for r in rows if r[1] is not None}
    want = {t: (sum(1 for r in uniq if r[1] == t), len({r[0] for r in uniq if r[1] == t and r[0] is not None})) for t in {r[1] for r in uniq}}
    counts = term_counts(df, leaf_rows=leaf_rows)
    assert {r["term"]: (r["n_rows"], r["n_records"]) for r in counts.collect()} == want
    marked = {r["term"]: r["mark"] for r in marks(counts, 80).collect()}
    assert marked["hot"] == "common" and marked["lost"] == "rare"


def test_a_hot_term_is_spread_over_the_tasks(spark, monkeypatch):
    """A term with half of all rows: no task gets more than twice the median, and the counts stay right."""
    monkeypatch.setattr("notegraph.operators.skew.SMALL_ROWS", 100)
    df = spark.range(20_000).selectExpr("concat('r', id % 7000) AS record", "if(id % 2 = 0, 'hot', concat('t', id % 500)) AS term", "'x' AS raw", "timestamp_ntz'2024-01-01 00:00:00' AS at")
    rows = {(r["record"], r["term"]) for r in df.collect()}
    got = {r["term"]: (r["n_rows"], r["n_records"]) for r in term_counts(df, leaf_rows=700).collect()}
    n = Counter(t for _, t in rows)
    assert got == {t: (k, k) for t, k in n.items()}
    keys = T._routed(df.withColumn("at", F.col("at").cast("string")), 8, 20_000)
    per_task = sorted(r["count"] for r in keys.groupBy(F.spark_partition_id()).count().collect())
    assert per_task[-1] <= 2 * per_task[len(per_task) // 2]


def test_one_term_in_one_record_and_full_repeats(spark):
    """Rows that neither the term's nor the record's hash can split are split by their own."""
    rows = spark.range(6_000).selectExpr("'r' AS record", "'t' AS term", "concat('raw', id % 3000) AS raw", "cast(null as timestamp_ntz) AS at")
    rows = rows.unionByName(spark.range(50).selectExpr("if(id = 0, null, concat('r', id)) AS record", "'t' AS term", "'x' AS raw", "cast(null as timestamp_ntz) AS at"))
    assert [tuple(r) for r in term_counts(rows, leaf_rows=300).collect()] == [("t", 3050, 50)]
    same = spark.range(5_000).selectExpr("'r' AS record", "'t' AS term", "'x' AS raw", "cast(null as timestamp_ntz) AS at")
    assert [tuple(r) for r in term_counts(same, leaf_rows=300).collect()] == [("t", 1, 1)]


def test_no_terms(spark):
    df = spark.createDataFrame([("r", None, "x", None)], "record string, term string, raw string, at timestamp_ntz")
    assert term_counts(df).count() == 0
