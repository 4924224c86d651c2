"""Parent-child rows to full hierarchies, in a number of rounds that is the logarithm of the depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.operators.skew import heavy_keys, prefix_sums, skew_join
from notegraph.session import cut

#: Blocks of the range join have at most 2^12 nodes.
BLOCK_BITS = 12


def clean(links: DataFrame) -> DataFrame:
    """child, parent: repeats once; rows with a null on either side link nothing."""
    return links.select("child", "parent").filter(F.col("child").isNotNull() & F.col("parent").isNotNull()).distinct()


def parents_of(links: DataFrame) -> DataFrame:
    """child, parent of the tree: a child with several parents belongs to the smallest of them; see surplus_parents."""
    return links.filter(F.col("child").isNotNull() & F.col("parent").isNotNull()).groupBy("child").agg(F.min("parent").alias("parent"))


def surplus_parents(links: DataFrame) -> DataFrame:
    """child, parent, chosen: the links of children with several parents that the tree leaves out."""
    chosen = parents_of(links).withColumnRenamed("parent", "chosen")
    return clean(links).join(chosen, "child").filter(F.col("parent") != F.col("chosen"))


def subtree_sizes(links: DataFrame, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(done, loose): nodes with the size of their subtree, and those that never reach a root.

    done: id, parent, size (itself included). Sizes go upward by doubling: after round k a node has
    counted its descendants less than 2^k away and points 2^k levels up, so a hierarchy of depth d
    takes log2(d) rounds, and a node of depth d travels through log2(d) of them. A round in which
    no node reaches its root ends it: if any hierarchy were deeper, some node would have reached its
    root in that round. What is left is unprocessed: it lies on a loop or below one. extra: further
    ids (column id) that are roots of their own if nothing else is known of them.
    """
    tree = parents_of(links)
    ids = tree.select(F.col("parent").alias("id")).union(tree.select("child"))
    if extra is not None:
        ids = ids.union(extra.select("id").filter(F.col("id").isNotNull()))
    nodes = cut(ids.distinct().join(tree.withColumnRenamed("child", "id"), "id", "left").select("id", "parent"))
    active = nodes.filter(F.col("parent").isNotNull()).select("id", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("size"))
    left, more = active.count(), []
    while left:
        arrived = active.groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        more.append(arrived)
        target = active.select(F.col("id").alias("up"), F.col("up").alias("over"))
        higher = skew_join(active, target, "up", "inner", heavy_keys(active, "up", rows=left)).select("id", F.col("over").alias("up"), "size")
        active = cut(higher.join(arrived, "id", "left").select("id", "up", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        now = active.count()
        if now == left:
            break
        left = now
    loose = nodes.join(active.select("id"), "id", "left_semi") if left else nodes.limit(0)
    if not more:
        return nodes.withColumn("size", F.lit(1).cast("bigint")), loose
    sizes = reduce(DataFrame.unionByName, more).groupBy("id").agg(F.sum("more").alias("more"))
    done = nodes.join(active.select("id"), "id", "left_anti") if left else nodes
    return cut(done.join(sizes, "id", "left").select("id", "parent", (F.coalesce("more", F.lit(0)) + 1).alias("size"))), loose


def _step(steps: DataFrame, pointer: DataFrame, rows: int) -> DataFrame:
    """`steps` (id, at) one pointer (id, at) further on; each id of `pointer` stands once."""
    target = pointer.select(F.col("id").alias("at"), F.col("at").alias("over"))
    return skew_join(steps, target, "at", "inner", heavy_keys(steps, "at", rows=rows)).drop("at").withColumnRenamed("over", "at")


def loops(loose: DataFrame) -> DataFrame:
    """id, loop_head: of nodes with one parent each, those on a loop, with the smallest id of that loop.

    loose: id, parent, the unprocessed nodes. Their image under 2^k steps shrinks to the loops
    themselves; once it keeps its size it is exactly them. The smallest id goes round by doubling, too.
    """
    nodes, n = cut(loose.select("id", F.col("parent").alias("at"))), -1
    steps, rows = nodes, nodes.count()
    while True:
        image = steps.select("at").distinct().count()
        if image == n:
            break
        n = image
        steps = cut(_step(steps, steps, rows))
    on = steps.select(F.col("at").alias("id")).distinct()
    ring = cut(nodes.join(on, "id", "left_semi").withColumn("least", F.col("id")))
    while n:
        target = ring.select(F.col("id").alias("at"), F.col("at").alias("over"), F.col("least").alias("other"))
        new = cut(ring.join(target, "at").select("id", F.col("over").alias("at"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("moved")))
        ring = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    return ring.select("id", F.col("least").alias("loop_head"))


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component: the nodes of `edges` (src, dst) that lie on a loop; those that reach each other share a component.

    What has no edge in or none out is trimmed. Then the smallest id that reaches a node colours it,
    and the nodes of a colour that reach its smallest id are a component; the rest goes round again.
    """
    edges, parts = cut(edges.select("src", "dst").distinct()), []
    left = edges.count()
    while left:
        while True:  # no loop goes through a node without an edge in or out
            edges = cut(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
            now = edges.count()
            if now == left:
                break
            left = now
        if not left:
            break
        colour = cut(edges.select(F.col("src").alias("id")).distinct().withColumn("colour", F.col("id")))
        while True:
            reached = edges.join(colour, edges["src"] == colour["id"]).groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("other"))
            new = cut(colour.join(reached, "id", "left").select("id", F.least("colour", "other").alias("colour"), (F.col("other") < F.col("colour")).alias("moved")))
            colour = new.drop("moved")
            if new.filter("moved").isEmpty():
                break
        ends = lambda side: colour.select(F.col("id").alias(side), F.col("colour").alias(f"{side}_colour"))
        inner = cut(edges.join(ends("src"), "src").join(ends("dst"), "dst").filter("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("colour")))
        found = cut(colour.filter("id = colour"))
        new = found
        while not new.isEmpty():
            back = inner.join(new.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "colour").distinct()
            new = cut(back.join(found, "id", "left_anti"))
            found = cut(found.unionByName(new))
        loops_of_one = inner.filter("src = dst").select(F.col("src").alias("id")).distinct().withColumn("own", F.lit(True))
        sizes = found.groupBy("colour").agg(F.count(F.lit(1)).alias("n"))
        parts.append(cut(found.join(sizes, "colour").join(loops_of_one, "id", "left").filter("n > 1 OR own").select("id", F.col("colour").alias("component"))))
        outside = lambda side: found.select(F.col("id").alias(side))
        edges = cut(inner.select("src", "dst").join(outside("src"), "src", "left_anti").join(outside("dst"), "dst", "left_anti"))
        left = edges.count()
    return reduce(DataFrame.unionByName, parts) if parts else edges.select(F.col("src").alias("id"), F.col("dst").alias("component")).limit(0)


def loop_nodes(links: DataFrame, loose: DataFrame | None = None) -> DataFrame:
    """id, loop_head: every node that lies on a loop of links, with the smallest id of all that it reaches and that reach it.

    All parents count. Where each child has one, sizes go upward and what is never processed
    holds the loops. Children with several parents are junctions: every node climbs by doubling to
    the junction above it, the junctions with the links between them make a small graph, and the
    loops of that are its strong components together with the nodes climbed over between them.
    loose: what subtree_sizes left unprocessed of the same links, if known.
    """
    edges = cut(clean(links))
    junctions = cut(edges.groupBy("child").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("child").alias("id")))
    if junctions.isEmpty():
        return loops(subtree_sizes(edges)[1] if loose is None else loose)
    plain = edges.join(junctions.withColumnRenamed("id", "child"), "child", "left_anti").select(F.col("child").alias("id"), F.col("parent").alias("at"))
    ids = edges.select(F.col("child").alias("id")).union(edges.select("parent")).distinct()
    first = cut(ids.join(plain, "id", "left").select("id", F.coalesce("at", "id").alias("at"), F.col("at").isNull().alias("top")))
    climb, rows = first, first.count()
    left = first.filter("NOT top").count()
    while left:
        target = climb.select(F.col("id").alias("at"), F.col("at").alias("over"), F.col("top").alias("over_top"))
        climb = cut(skew_join(climb, target, "at", "inner", heavy_keys(climb, "at", rows=rows)).select("id", F.col("over").alias("at"), F.col("over_top").alias("top")))
        now = climb.filter("NOT top").count()
        if now == left:
            break
        left = now
    pure = loops(climb.filter("NOT top").select("id").join(plain.withColumnRenamed("at", "parent"), "id"))
    tops = climb.filter("top").select(F.col("id").alias("parent"), F.col("at").alias("dst")).join(junctions.withColumnRenamed("id", "dst"), "dst", "left_semi")
    between = cut(edges.join(junctions.withColumnRenamed("id", "child"), "child", "left_semi").join(tops, "parent").select(F.col("child").alias("src"), "parent", "dst"))
    inner = cut(strong_components(between))
    own = lambda side: inner.select(F.col("id").alias(side), F.col("component").alias(f"{side}_c"))
    met = between.join(own("src"), "src").join(own("dst"), "dst").filter("src_c = dst_c")
    over = cut(met.select(F.col("parent").alias("id"), F.col("src_c").alias("component")).distinct())
    pointer, n = first.select("id", "at"), 0
    while (now := over.count()) > n:  # all nodes up to the junction, 2^k steps in round k
        n = now
        up = _step(over.withColumn("at", F.col("id")), pointer, n).select(F.col("at").alias("id"), "component")
        over = cut(over.unionByName(up).distinct())
        pointer = cut(_step(pointer, pointer, rows))
    members = inner.unionByName(over).distinct()
    heads = members.groupBy("component").agg(F.min("id").alias("loop_head"))
    return members.join(heads, "component").select("id", "loop_head").unionByName(pure)


def nested_sets(done: DataFrame, chains: bool = False) -> DataFrame:
    """id, parent, root, depth, lft, rgt, below (and chain): preorder ranges inside each hierarchy.

    Siblings get consecutive ranges by prefix sums of their sizes; the offsets are summed down from
    the root by doubling, where a node stays only until it has reached its root. Descendants of a
    node are those of the same root with lft in (lft, rgt]; below is their number. Roots have depth
    0 and lft 0. chains: also the nodes from the root to the node itself, as long as the depth.
    """
    chain = ["chain"] if chains else []
    own = [F.array("id").alias("chain")] if chains else []
    kids = prefix_sums(done.filter(F.col("parent").isNotNull()), ["parent"], [F.col("id")], "size", "before", rows=done.count())
    active = cut(kids.select("id", "parent", "size", F.col("parent").alias("up"), (F.col("before") + 1).alias("lft"), F.lit(1).alias("depth"), F.col("parent").alias("root"), *own))
    roots = done.filter(F.col("parent").isNull())
    placed = roots.select("id", "parent", "size", F.lit(None).cast("string").alias("up"), F.lit(0).cast("bigint").alias("lft"), F.lit(0).alias("depth"), F.col("id").alias("root"), *own)
    columns = ["up", "lft", "depth", "root", *chain]
    while left := active.count():
        target = placed.unionByName(active).select(F.col("id").alias("at"), *[F.col(c).alias(f"u_{c}") for c in columns])
        joined = skew_join(active.withColumnRenamed("up", "at"), target, "at", "inner", heavy_keys(active, "up", rows=left))
        moved = cut(
            joined.select(
                "id", "parent", "size", F.col("u_up").alias("up"), (F.col("lft") + F.col("u_lft")).alias("lft"), (F.col("depth") + F.col("u_depth")).alias("depth"), F.col("u_root").alias("root"),
                *([F.concat("u_chain", "chain").alias("chain")] if chains else []),
            )
        )
        placed = placed.unionByName(moved.filter(F.col("up").isNull()))
        active = moved.filter(F.col("up").isNotNull())
    return placed.select("id", "parent", "root", "depth", "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"), (F.col("size") - 1).alias("below"), *chain)


def descendants(sets: DataFrame) -> DataFrame:
    """ancestor, id, steps: every node with every node above it, by nested-set ranges.

    A range join without nested loops: a range of length s is covered by aligned blocks of
    2^min(log2 s, BLOCK_BITS); a node lies in one block of each width that occurs in its
    hierarchy. Blocks are equi-joined and the range is verified. A block holds at most
    2^BLOCK_BITS nodes, and the ancestor's depth travels with it, so the root of a third of all
    nodes is no hot key either.
    """
    inner = sets.filter("below > 0").withColumn("w", F.least(F.floor(F.log2(F.col("below").cast("double"))).cast("int"), F.lit(BLOCK_BITS)))
    width = lambda at: F.expr(f"shiftright({at}, w)")
    blocks = inner.select("root", F.col("id").alias("ancestor"), F.col("lft").alias("lo"), F.col("rgt").alias("hi"), F.col("depth").alias("top"), "w", F.explode(F.sequence(width("lft + 1"), width("rgt"))).alias("block"))
    widths = inner.groupBy("root").agg(F.collect_set("w").alias("ws"))  # at most BLOCK_BITS + 1 for each root
    below = sets.filter("depth > 0")
    points = skew_join(below, widths, "root", "inner", heavy_keys(below, "root")).select("root", "id", "lft", "depth", F.explode("ws").alias("w"))
    points = points.withColumn("block", width("lft"))
    return (
        points.join(blocks, ["root", "w", "block"])
        .filter("lft > lo AND lft <= hi")
        .select("ancestor", "id", (F.col("depth") - F.col("top")).alias("steps"))
    )


def hierarchy(links: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """For each node: path, parent, root, depth, chain, lft, rgt, below, loop_head.

    links: child, parent. A child with several parents belongs to the smallest of them here;
    surplus_parents gives the other links. chain lists the nodes from the root to the node itself.
    Nodes that reach no root have no depth; nodes on a loop, through whichever parent, have
    loop_head. Null links are skipped, repeats count once, a node that is its own parent is a loop
    of one, empty tables give no rows.
    """
    done, loose = subtree_sizes(links, extra)
    sets = nested_sets(done, chains=True)
    none = lambda t: F.lit(None).cast(t)
    off = loose.select("id", "parent", none("string").alias("root"), none("int").alias("depth"), none("bigint").alias("lft"), none("bigint").alias("rgt"), none("bigint").alias("below"), none("array<string>").alias("chain"))
    return sets.unionByName(off).join(loop_nodes(links, loose), "id", "left").withColumnRenamed("id", "path")


def part_of(edge: DataFrame) -> DataFrame:
    """child, parent of the part_of rows."""
    return edge.filter("kind = 'part_of' AND dst IS NOT NULL").select(F.col("src").alias("child"), F.col("dst").alias("parent"))
