import random

import pytest

from notegraph.operators.hierarchy import descendants, hierarchy, loop_nodes, loops, nested_sets, strong_components, subtree_sizes, surplus_parents
from notegraph.operators.skew import heavy_keys, prefix_sums, skew_join
from pyspark.sql import functions as F


def links(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


def brute(pairs):
    parent = {}
    for c, p in pairs:
        if c is not None and p is not None:
            parent[c] = min(p, parent.get(c, p))
    nodes = set(parent) | set(parent.values())
    out = {}
    for n in nodes:
        chain, seen = [n], {n}
        while chain[-1] in parent and parent[chain[-1]] not in seen:
            chain.append(parent[chain[-1]])
            seen.add(chain[-1])
        if chain[-1] in parent:
            loop = chain[chain.index(parent[chain[-1]]) :]
            out[n] = (None, min(loop) if n in loop else None)
        else:
            out[n] = (tuple(reversed(chain)), None)
    return out


def random_forest(seed):
    rnd = random.Random(seed)
    names = [f"n{i:03}" for i in range(120)]
    pairs = [(n, names[rnd.randrange(i)]) for i, n in enumerate(names) if i and rnd.random() < 0.9]
    pairs += [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)]  # a chain
    pairs += [("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("below", "l1"), ("lower", "below"), ("self", "self"), ("on self", "self")]
    pairs += [pairs[0], (None, "x"), ("x", None)]
    rnd.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    pairs = random_forest(seed)
    want = brute(pairs)
    got = {r["path"]: r for r in hierarchy(links(spark, pairs)).collect()}
    assert set(got) == set(want)
    for n, (chain, head) in want.items():
        r = got[n]
        assert r["loop_head"] == head
        assert (tuple(r["chain"]) if r["chain"] else None) == chain
        if chain:
            assert (r["depth"], r["root"]) == (len(chain) - 1, chain[0])
            assert r["below"] == sum(1 for c, _ in want.values() if c and n in c[:-1])
    inside = {(a, b) for a in got for b in got if got[a]["lft"] is not None and got[b]["lft"] is not None and got[a]["root"] == got[b]["root"] and got[a]["lft"] < got[b]["lft"] <= got[a]["rgt"]}
    assert inside == {(a, n) for n, (c, _) in want.items() if c for a in c[:-1]}


def test_descendants_and_loops(spark):
    done, loose = subtree_sizes(links(spark, [("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "x"), ("z", "x")]))
    assert {tuple(r) for r in descendants(nested_sets(done)).collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)}
    assert {tuple(r) for r in loops(loose).collect()} == {("x", "x"), ("y", "x")}


def brute_loops(pairs):
    over = {}
    for c, p in pairs:
        if c is not None and p is not None:
            over.setdefault(c, set()).add(p)
    reach = {}
    for n in over:
        seen, todo = set(), [n]
        while todo:
            for p in over.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        reach[n] = seen
    return {(n, min(m for m in r if n in reach.get(m, ()))) for n, r in reach.items() if n in r}


def test_loop_through_a_second_parent(spark):
    pairs = [("a", "b"), ("a", "z"), ("z", "a"), ("b", "r"), (None, "a"), ("a", None), ("a", "b")]
    df = links(spark, pairs).withColumn("kind", F.lit("clash")).withColumn("id", F.lit(1))
    assert {tuple(r) for r in loop_nodes(df).collect()} == {("a", "a"), ("z", "a")}
    assert {tuple(r) for r in surplus_parents(df).collect()} == {("a", "z", "b")}
    got = {r["path"]: (r["depth"], r["loop_head"]) for r in hierarchy(df).collect()}
    assert got == {"r": (0, None), "b": (1, None), "a": (2, "a"), "z": (3, "a")}


@pytest.mark.parametrize("seed", range(8))
def test_loops_of_random_graphs(spark, seed):
    """Children with several parents, chains between them, loops inside loops, loops of one."""
    rnd = random.Random(seed)
    n = rnd.choice([12, 30, 60])
    pairs = [(f"n{rnd.randrange(n):02}", f"n{rnd.randrange(n):02}") for _ in range(rnd.choice([n // 2, n, n + n // 3]))]
    pairs += [(f"c{i:02}", f"c{i + 1:02}") for i in range(11)] + [("c11", rnd.choice(["c03", "c00", "end"])), ("c05", "n01"), ("n02", "c01")]
    pairs += [("l1", "l2"), ("l2", "l1"), ("below", "l1"), ("self", "self"), ("self", "n03"), ("on self", "self"), (None, "x"), ("x", None)]
    assert {tuple(r) for r in loop_nodes(links(spark, pairs)).collect()} == brute_loops(pairs)


def test_components_of_loops_that_meet(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e"), ("e", "f"), ("x", "x")], "src string, dst string")
    assert {tuple(r) for r in strong_components(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("x", "x")}
    assert strong_components(edges.limit(0)).count() == 0


def test_extra_and_empty(spark):
    extra = spark.createDataFrame([("alone",), (None,), ("b",)], "id string")
    got = {r["path"]: (r["depth"], r["chain"]) for r in hierarchy(links(spark, [("b", "a")]), extra).collect()}
    assert got == {"alone": (0, ["alone"]), "a": (0, ["a"]), "b": (1, ["a", "b"])}
    assert hierarchy(links(spark, [])).count() == 0
    assert loop_nodes(links(spark, [])).count() == 0 and loop_nodes(links(spark, [("a", "b")])).count() == 0


def test_skew_helpers(spark):
    df = spark.range(1000).selectExpr("id", "if(id < 400, 'hot', concat('k', id)) AS key")
    assert heavy_keys(df, "key") == ["hot"]
    assert heavy_keys(df.limit(0), "key") == []
    right = spark.createDataFrame([("hot", 1), ("k500", 2)], "key string, n int")
    for how, rows in (("inner", 401), ("left", 1000)):
        assert skew_join(df, right, "key", how, ["hot"]).count() == rows
    nulls = df.selectExpr("id", "if(id % 2 = 0, null, key) AS key")
    assert skew_join(nulls, right, "key", "left", ["hot"]).count() == 1000
    sums = prefix_sums(df.withColumn("one", F.lit(1)), ["key"], [F.col("id")], "one", "before")
    assert sorted(r["before"] for r in sums.filter("key = 'hot'").collect()) == list(range(400))
