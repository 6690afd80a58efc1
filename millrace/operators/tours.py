"""Orders of forests: Euler tours ranked by pointer jumping, ancestors by ranges, common ancestors by heavy paths.

A node is entered and left once on a tour; each step points to the one before it.
All steps jump at once, twice as far in every round, and add up what they
pass, so numbers of a tree of n nodes take about log2(2 n) rounds of joins, whatever
its height, and rows only as many as there are steps. An ancestor is
then a range of numbers: x is above y or the same if pre(x) <= pre(y) < pre(x) + size(x).

Trees are told apart by key columns `by`, whose nodes have one numbering. Repeated rows count
once; a node of two parents and a cycle are errors; a parent that has no row of its own counts as
none; null nodes are left out. An empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .graph import cut


def jump(links: DataFrame, sums: list[str]) -> DataFrame:
    """(id, end, *sums) of links (id, to, *sums): the last id that `to` leads to, and the sums over all ids on the way, both ends too.

    Ids are distinct; `to` is null at an end. Each round writes the table, with the links that haven't
    reached their end going twice as far as in the last one.
    """
    now = cut(links.select("id", "to", F.col("id").alias("end"), *sums))
    for _ in range(2 + max(1, now.count()).bit_length()):
        open_ = now.where("to is not null")
        if open_.isEmpty():
            return now.select("id", "end", *sums)
        on = now.select(*(F.col(c).alias(f"_{c}") for c in now.columns))
        far = open_.join(on, F.col("to") == F.col("_id")).select("id", F.col("_to").alias("to"), F.col("_end").alias("end"), *((F.col(c) + F.col(f"_{c}")).alias(c) for c in sums))
        now = cut(far.union(now.where("to is null")))
    raise ValueError("the table has a cycle")


def tour(nodes: DataFrame, by: tuple[str, ...] = (), node: str = "node", parent: str = "parent") -> DataFrame:
    """(*by, node, parent, pre, post, size, level, first_leaf, leaves) of every node.

    pre and post number the nodes of a key from 0, before and after those below, children in the
    order of their names (as are the roots of one key); size and leaves count the node's
    subtree, itself included; level is 0 at a root; first_leaf is the number of leaves before
    the node's own.
    """
    by = list(by)
    up = F.when(F.min(parent).eqNullSafe(F.max(parent)), F.min(parent)).otherwise(F.raise_error(F.lit("a node has two parents")))
    rows = cut(nodes.where(F.col(node).isNotNull()).groupBy(*by, F.col(node).alias("node")).agg(up.alias("parent")).withColumn("id", F.monotonically_increasing_id()))
    above = rows.select(*by, F.col("node").alias("parent"), F.col("id").alias("above"))
    rows_ = cut(rows.join(above, [*by, "parent"], "left").select("id", *by, "node", "above"))
    # a key with very many children, or roots, is scanned in pieces
    siblings = scan.lay(rows_, [*by, "above"], ["node"]).add(before=scan.previous("id")).done().select("id", "above", F.col("before.v").alias("before"))
    last = rows_.where("above is not null").groupBy("above").agg(F.max_by("id", "node").alias("last")).withColumnRenamed("above", "id")
    steps = cut(siblings.join(last, "id", "left"))
    inner = steps.where("last is not null")

    def left(df: DataFrame, c: str) -> DataFrame:
        """Adds `left`, the step that leaves the node c: that of a leaf is also the one that enters it."""
        ends = inner.select(F.col("id").alias(c), F.lit(1).alias("_inner"))
        return df.join(ends, c, "left").withColumn("left", 2 * F.col(c) + F.coalesce("_inner", F.lit(0)))

    leaf = F.col("last").isNull().cast("long")
    enter = left(steps, "before").select(
        (2 * F.col("id")).alias("id"), F.coalesce("left", 2 * F.col("above")).alias("to"),
        F.lit(1).cast("long").alias("entered"), leaf.alias("met"), (1 + leaf).alias("steps"),
    )
    leave = left(inner, "last").select((2 * F.col("id") + 1).alias("id"), F.col("left").alias("to"), F.lit(0).cast("long").alias("entered"), F.lit(0).cast("long").alias("met"), F.lit(1).cast("long").alias("steps"))
    ranked = jump(enter.union(leave), ["entered", "met", "steps"])
    counts = F.struct("entered", "met", "steps")
    at = ranked.groupBy(F.floor(F.col("id") / 2).alias("id")).agg(F.max(F.when(F.col("id") % 2 == 0, counts)).alias("i"), F.max(F.when(F.col("id") % 2 == 1, counts)).alias("o"))
    o = F.coalesce("o", "i")
    own = F.col("o").isNull().cast("long")
    numbers = at.select(
        "id", (F.col("i.entered") - 1).alias("pre"), (o["steps"] - o["entered"] - 1).alias("post"), (o["entered"] - F.col("i.entered") + 1).alias("size"),
        (2 * (F.col("i.entered") - 1) - (F.col("i.steps") - 1 - own)).alias("level"), (F.col("i.met") - own).alias("first_leaf"), (o["met"] - F.col("i.met") + own).alias("leaves"),
    )
    known = rows_.join(rows.select("id", "parent"), "id").withColumn("parent", F.when(F.col("above").isNotNull(), F.col("parent")))
    return known.join(numbers, "id").select(*by, "node", "parent", "pre", "post", "size", "level", "first_leaf", "leaves")


def heavy_paths(t: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, node, parent, level, head) of tour(): the nodes fall into paths that follow the largest child; head is the top one of a node's path.

    A way to the root crosses at most log2(n) of them.
    """
    by = list(by)
    t = cut(t.select(*by, "node", "parent", "level", "size").withColumn("id", F.monotonically_increasing_id()))
    heavy = t.where("parent is not null").groupBy(*by, "parent").agg(F.max(F.struct("size", "node")).alias("h")).select(*by, F.col("parent").alias("up"), F.col("h.node").alias("node"))
    up = t.select(*by, F.col("node").alias("up"), F.col("id").alias("to"))
    links = t.select("id", *by, "node").join(heavy, [*by, "node"], "left").join(up, [*by, "up"], "left").select("id", "to")
    ends = jump(links, [])
    heads = t.select(F.col("id").alias("end"), F.col("node").alias("head"))
    return t.join(ends, "id").join(heads, "end").select(*by, "node", "parent", "level", "head")


def routes(paths: DataFrame, *more: str) -> DataFrame:
    """(node, route) of heavy_paths() of one table: the (head, level) of each path on the way from the root down to the node, and the level at which that is left, with the columns `more` of the node there.

    Two nodes' common ancestor is on the last path whose head both routes share: the higher of the two levels there.
    """
    rows = paths.join(paths.where("node = head").select("head", F.col("parent").alias("up")), "head")
    rows = cut(rows.select("node", "up", F.array(F.struct("head", F.col("level").cast("int").alias("level"), *more)).alias("own")))
    now = rows.where("up is null").select("node", F.col("own").alias("route"))
    found = [now]
    while not (now := cut(rows.join(now.select(F.col("node").alias("up"), "route"), "up").select("node", F.concat("route", "own").alias("route")))).isEmpty():
        found.append(now)
    return cut(reduce(DataFrame.union, found))


def lca(paths: DataFrame, pairs: DataFrame, a: str = "a", b: str = "b", by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, a, b, lca, distance) of distinct pairs, from heavy_paths(): the lowest common ancestor and the number of edges between the two.

    In each round, of two nodes on different paths the one whose path begins lower goes to
    the parent of that path's head. Pairs with unknown nodes, or of two trees, are left out.
    """
    by = list(by)
    paths = cut(paths)
    heads = paths.where("node = head").select(*by, "head", F.col("parent").alias("up"), F.col("level").alias("head_level"))
    at = cut(paths.join(heads.select(*by, "head", "head_level"), [*by, "head"]).select(*by, "node", "level", "head", "head_level"))
    over = at.select(*by, F.col("node").alias("up"), *(F.col(c).alias(f"up_{c}") for c in ("level", "head", "head_level")))
    climb = cut(heads.join(over, [*by, "up"]).select(*by, F.col("head").alias("_key"), F.struct(F.col("up").alias("node"), F.col("up_level").alias("level"), F.col("up_head").alias("head"), F.col("up_head_level").alias("head_level")).alias("_up")))
    there = F.struct("node", "level", "head", "head_level")
    now = pairs.select(*by, a, b).distinct()
    for c in (a, b):
        now = now.join(at.select(*by, F.col("node").alias(c), there.alias(f"_{c}")), [*by, c])
    now = now.select(*by, a, b, F.col(f"_{a}").alias("_a"), F.col(f"_{b}").alias("_b"), (F.col(f"_{a}.level") + F.col(f"_{b}.level")).alias("_far"))
    now = cut(now)
    while not (open_ := now.where("_a.head <> _b.head")).isEmpty():
        first = F.col("_a.head_level") >= F.col("_b.head_level")
        moved = open_.withColumn("_key", F.when(first, F.col("_a.head")).otherwise(F.col("_b.head"))).join(climb, [*by, "_key"])
        moved = moved.select(*by, a, b, F.when(first, F.col("_up")).otherwise(F.col("_a")).alias("_a"), F.when(first, F.col("_b")).otherwise(F.col("_up")).alias("_b"), "_far")
        now = cut(moved.union(now.where("_a.head = _b.head")))
    met = F.when(F.col("_a.level") <= F.col("_b.level"), F.col("_a")).otherwise(F.col("_b"))
    return now.select(*by, a, b, met["node"].alias("lca"), (F.col("_far") - 2 * met["level"]).cast("int").alias("distance"))


def extremes(t: DataFrame, values: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, node, low, high) of tour(): the least and largest value (null without one) of the leaves below each node, from values (*by, node, value).

    A node's leaves are a range; it is the union of two ranges whose length is a power of two,
    and the extremes of such ranges come from those of half the length.
    """
    by = list(by)
    t = cut(t.select(*by, "node", "first_leaf", "leaves", "size"))
    bits = F.floor(F.log2("leaves")).cast("int")
    # a logarithm may be off by a rounding: the power must not exceed the number
    bits = F.when(F.pow(F.lit(2.0), bits) > F.col("leaves"), bits - 1).otherwise(bits)
    asked = cut(t.withColumn("_bits", bits))
    known = values.groupBy(*by, "node").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    span = cut(t.where("size = 1").join(known, [*by, "node"], "left").select(*by, F.col("first_leaf").alias("_at"), "low", "high"))
    found, length = [], 1
    most = asked.agg(F.max("_bits")).first()[0] or 0
    for k in range(most + 1):
        mine = asked.where(F.col("_bits") == k).withColumn("_at", F.explode(F.array("first_leaf", F.col("first_leaf") + F.col("leaves") - length)))
        found.append(cut(mine.join(span, [*by, "_at"]).groupBy(*by, "node").agg(F.min("low").alias("low"), F.max("high").alias("high"))))
        if k < most:
            after = span.select(*by, (F.col("_at") - length).alias("_at"), F.col("low").alias("_low"), F.col("high").alias("_high"))
            span = cut(span.join(after, [*by, "_at"], "left").select(*by, "_at", F.least("low", "_low").alias("low"), F.greatest("high", "_high").alias("high")))
            length *= 2
    return reduce(DataFrame.union, found)
