"""Ancestral recombination graphs: nodes (name, event, age, pos, parents), their edges and local trees.

The first parent of a recombination node holds left of its position, the
second from there on; one with a single parent has none from its position on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, intervals, trees
from .ordered import numbered


def edges(arg: DataFrame, start: float, end: float) -> DataFrame:
    """(child, parent, lo, hi): the part [lo, hi) of start to end for which the child descends from the parent."""
    rows = arg.select(F.col("name").alias("child"), "event", "pos", F.posexplode("parents").alias("k", "parent"))
    cut = F.col("event") == "recomb"
    lo = F.when(cut & (F.col("k") == 1), F.greatest("pos", F.lit(float(start)))).otherwise(F.lit(float(start)))
    hi = F.when(cut & (F.col("k") == 0), F.least("pos", F.lit(float(end)))).otherwise(F.lit(float(end)))
    return rows.select("child", "parent", lo.alias("lo"), hi.alias("hi")).where("lo < hi")


def recombinations(arg: DataFrame, start: float, end: float) -> DataFrame:
    """(pos) of the recombination nodes from start to end."""
    return arg.where("event = 'recomb'").where(F.col("pos").between(start, end)).select("pos")


def blocks(arg: DataFrame, start: float, end: float) -> DataFrame:
    """(lo, hi): the parts between neighbouring recombinations."""
    spark = arg.sparkSession
    at = recombinations(arg, start, end).select(F.col("pos").cast("double").alias("lo")).union(spark.createDataFrame([(float(start),)], "lo double")).distinct()
    n = numbered(at, ["lo"], "i")
    after = n.select((F.col("i") - 1).alias("i"), F.col("lo").alias("hi"))
    return n.join(after, "i", "left").select("lo", F.coalesce("hi", F.lit(float(end))).alias("hi")).where("lo < hi")


def _pieces(arg: DataFrame, start: float, end: float) -> DataFrame:
    return _laid(arg, start, end)[0]


def _laid(arg: DataFrame, start: float, end: float) -> tuple[DataFrame, DataFrame]:
    """(node, parent, n, age, dist, s, e): the parts [s, e) in which a node has one parent, null at a root, and n leaves below it; and the _ways() of all nodes.

    Ways up are followed over parts and not tree by tree, so a way that many
    neighbouring trees share is one row. Nodes that no leaf reaches are left out.
    """
    ups = graph.cut(edges(arg, start, end).select(F.col("child").alias("node"), "parent", F.col("lo").alias("s"), F.col("hi").alias("e")).distinct())
    tops = intervals.subtract(ups.select(F.col("parent").alias("node"), "s", "e"), ups.select("node", "s", "e"), ["node"])
    rows = graph.cut(ups.union(tops.select("node", F.lit(None).cast("string"), "s", "e")))
    leaves = arg.where("event = 'gene'").select(F.col("name").alias("node"))
    ways = graph.cut(_ways(rows))
    below = ways.join(leaves, "node").select(F.col("ancestor").alias("node"), "s", "e")
    counts = intervals.coverage(below, ["node"]).where("depth > 0").select("node", F.col("depth").alias("n"), F.col("s").alias("_s"), F.col("e").alias("_e"))
    met = rows.join(counts, "node").where("s < _e and _s < e").select("node", "parent", "n", F.greatest("s", "_s").alias("s"), F.least("e", "_e").alias("e"))
    ages = arg.select(F.col("name").alias("node"), "age")
    up = ages.select(F.col("node").alias("parent"), F.col("age").alias("top"))
    return graph.cut(met.join(ages, "node").join(up, "parent", "left").select("node", "parent", "n", "age", (F.col("top") - F.col("age")).alias("dist"), "s", "e")), ways


def _ways(rows: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, ancestor, depth, s, e) of rows (node, parent, s, e), with every node its own ancestor at 0; path doubling as in graph.closure()."""
    hop = rows.where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"), "s", "e")
    found = rows.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"), "s", "e").union(hop)

    def on(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(F.col("node").alias("ancestor"), *(F.col(c).alias(f"_{c}") for c in ("ancestor", "depth", "s", "e")))
        met = a.join(b, "ancestor").where("s < _e and _s < e")
        return met.select("node", F.col("_ancestor").alias("ancestor"), (F.col("depth") + F.col("_depth")).alias("depth"), F.greatest("s", "_s").alias("s"), F.least("e", "_e").alias("e"))

    for _ in range(rounds):
        new = graph.cut(on(hop, hop))
        if new.isEmpty():
            return found
        found, hop = graph.cut(found.union(new).union(on(new, found.where("depth > 0"))).distinct()), new
    raise ValueError(f"not settled after {rounds} rounds: the graph has a cycle")


def _in_trees(pieces: DataFrame, parts: DataFrame, start: float, end: float) -> DataFrame:
    """Rows (s, e, ...) beside the tree_id of each part whose low end they hold."""
    width = (end - start) / max(1, parts.count()) or 1.0
    return intervals.stab(parts.select(F.col("lo").alias("tree_id")), pieces, [], width, "tree_id").where("tree_id < e")


def _common(pieces: DataFrame, parts: DataFrame, start: float, end: float) -> DataFrame:
    """(tree_id, m): the number of leaves and, negative, the age of the youngest node of each tree that most leaves lead to, their common ancestor."""
    each = pieces.groupBy("s", "e").agg(F.max(F.struct("n", (-F.col("age")).alias("age"))).alias("m")).select("s", "e", "m")
    return graph.cut(_in_trees(each, parts, start, end).groupBy("tree_id").agg(F.max("m").alias("m")))


def local_trees(arg: DataFrame, parts: DataFrame, start: float, end: float) -> DataFrame:
    """(tree_id, node, parent, dist) of the tree at the low end of every part; tree_id is that end.

    Nodes that no leaf reaches are left out, as is all above the lowest
    common ancestor of the leaves.
    """
    pieces = _pieces(arg, start, end)
    rows = _in_trees(pieces, parts, start, end).join(_common(pieces, parts, start, end), "tree_id").where("n < m.n or age = -m.age")
    under = F.col("n") < F.col("m.n")
    return rows.select("tree_id", "node", F.when(under, F.col("parent")).alias("parent"), F.when(under, F.col("dist")).alias("dist"))


def length(arg: DataFrame, start: float, end: float) -> DataFrame:
    """(lo, hi, branches): the branch lengths of each part's tree; their products with hi - lo add up to the graph's.

    Branches over equal parts and as many leaves are added up before they meet the trees.
    """
    parts = graph.cut(blocks(arg, start, end))
    pieces = _pieces(arg, start, end)
    common = _common(pieces, parts, start, end)
    sums = pieces.groupBy("s", "e", "n").agg(F.sum("dist").alias("dist"))
    met = _in_trees(sums, parts, start, end).join(common, "tree_id").where("n < m.n").groupBy("tree_id").agg(F.sum("dist").alias("branches"))
    t = common.select("tree_id").join(met, "tree_id", "left").select(F.col("tree_id").alias("lo"), F.coalesce("branches", F.lit(0.0)).alias("branches"))
    return parts.join(t, "lo").select("lo", "hi", "branches")


def _cuts(arg: DataFrame, parts: DataFrame) -> DataFrame:
    """(tree_id, node, pos, rtime) of the recombination nodes and the trees left of their places."""
    at = arg.where("event = 'recomb'").select(F.col("name").alias("node"), F.col("age").alias("rtime"), "pos")
    return parts.select(F.col("lo").alias("tree_id"), F.col("hi").alias("pos")).join(at, "pos")


def _held(asked: DataFrame, pieces: DataFrame, common: DataFrame, node: str = "node") -> DataFrame:
    """The distinct (tree_id, node) of asked that are in the local tree of that place."""
    at = asked.select("tree_id", node).distinct().join(pieces.select(F.col("node").alias(node), "n", "age", "s", "e"), node).where("s <= tree_id and tree_id < e")
    return at.join(common, "tree_id").where("n < m.n or age = -m.age").select("tree_id", node).distinct()


def _roots(pieces: DataFrame, parts: DataFrame, common: DataFrame, start: float, end: float) -> DataFrame:
    """(tree_id, root): the common ancestor of every local tree, and what has no parent beside it."""
    tops = common.select("tree_id", F.col("m.n").alias("n"), (-F.col("m.age")).alias("age")).join(pieces.select("node", "n", "age", "s", "e"), ["n", "age"]).where("s <= tree_id and tree_id < e")
    loose = _in_trees(pieces.where("parent is null"), parts, start, end).join(common, "tree_id").where("n < m.n")
    return tops.select("tree_id", F.col("node").alias("root")).union(loose.select("tree_id", "node")).distinct()


def visible_recombinations(arg: DataFrame, start: float, end: float) -> DataFrame:
    """(name, pos) of the recombination nodes that some leaf of the tree left of their place descends from."""
    parts = graph.cut(blocks(arg, start, end))
    return _cuts(arg, parts).join(local_trees(arg, parts, start, end).select(*trees.ID), trees.ID).select(F.col("node").alias("name"), "pos")


def _over(edges_: DataFrame, leaves: DataFrame) -> DataFrame:
    """(name): the leaves and all that edges (child, parent) lead to from them, a level of nodes a round."""
    seen = front = graph.cut(leaves.toDF("name").distinct())
    while not front.isEmpty():
        up = edges_.join(front, edges_["child"] == front["name"]).select(F.col("parent").alias("name")).distinct()
        front = graph.cut(up.join(seen, "name", "left_anti"))
        seen = graph.cut(seen.union(front))
    return seen


def subgraph(arg: DataFrame, start: float, end: float) -> DataFrame:
    """The graph of start to end: what its leaves descend from there.

    A recombination node that lies outside keeps one parent and is a plain node
    then (event coal, pos 0). Nodes above the common ancestor of all stay.
    """
    inside = F.filter("parents", lambda _, k: F.when(F.col("event") != "recomb", F.lit(True)).when(k == 0, F.col("pos") > start).otherwise(F.col("pos") < end))
    plain = (F.col("event") == "recomb") & ((F.col("pos") <= start) | (F.col("pos") >= end))
    rows = arg.withColumns({"_in": inside, "_plain": plain})  # a step of their own, as a lambda would see the new event and pos
    rows = rows.select("name", F.when(F.col("_plain"), "coal").otherwise(F.col("event")).alias("event"), "age", F.when(F.col("_plain"), 0.0).otherwise(F.col("pos")).alias("pos"), F.col("_in").alias("parents"))
    up = rows.select(F.col("name").alias("child"), F.explode("parents").alias("parent"))
    return rows.join(_over(up, rows.where("event = 'gene'").select("name")), "name", "left_semi")


def subgraph_of(arg: DataFrame, leaves: DataFrame, keep_single: bool = False) -> DataFrame:
    """The graph of some of the leaves (name): what they descend from, without nodes of one child and one parent unless keep_single."""
    up = arg.select(F.col("name").alias("child"), F.explode("parents").alias("parent"))
    rows = arg.join(_over(up, leaves), "name", "left_semi").select(*arg.columns)
    return rows if keep_single else without_single(rows)


def without_single(arg: DataFrame) -> DataFrame:
    """The graph without nodes that have one child and one parent, and without roots of one child."""
    rows = graph.cut(arg)
    while True:
        kids = rows.select(F.explode("parents").alias("name")).groupBy("name").agg(F.count("*").alias("_kids")).where("_kids = 1").select("name")
        lone = graph.cut(rows.join(kids, "name", "left_semi").where("size(parents) < 2").select("name", F.get("parents", F.lit(0)).alias("to")))
        if lone.isEmpty():
            return rows
        more = True
        while more:  # to the first parent that stays, twice as far each round
            jump = lone.select(F.col("name").alias("to"), F.col("to").alias("next"), F.lit(True).alias("on"))
            lone = graph.cut(lone.join(jump, "to", "left").select("name", F.when(F.col("on"), F.col("next")).otherwise(F.col("to")).alias("to"), "on"))
            more = not lone.where("on").isEmpty()
            lone = lone.select("name", "to")
        stay = rows.join(lone.select("name"), "name", "left_anti")
        up = stay.select("name", F.posexplode("parents").alias("k", "parent")).join(lone.select(F.col("name").alias("parent"), "to", F.lit(True).alias("on")), "parent", "left")
        new = up.withColumn("to", F.when(F.col("on"), F.col("to")).otherwise(F.col("parent"))).where("to IS NOT NULL")
        new = new.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "to"))), lambda x: x["to"]).alias("_p"))
        rows = graph.cut(stay.join(new, "name", "left").withColumn("parents", F.coalesce("_p", F.array().cast("array<string>"))).select(*arg.columns))


def rearrangements(arg: DataFrame, start: float, end: float) -> DataFrame:
    """(pos, rnode, rtime, cnode, ctime): how the tree left of each recombination becomes the one right of it.

    The branch above rnode is cut at rtime and joined to the branch above cnode
    at ctime. Both are nodes of the tree on the left that are leaves or have
    several children there; cnode is its root where the lineage joins above that. A
    recombination that no leaf of the left tree descends from makes no row, and
    each of several at one place is held against the same left tree. Ancestors
    come from ways over parts that neighbouring trees share, for the nodes asked for only, so local trees aren't listed.
    """
    parts = graph.cut(blocks(arg, start, end))
    pieces, every = _laid(arg, start, end)
    common = _common(pieces, parts, start, end)
    every = every.where("depth > 0").select("node", F.col("ancestor").alias("to"), "depth", "s", "e")
    cut = graph.cut(_cuts(arg, parts))
    cut = cut.join(_held(cut, pieces, common), trees.ID)
    cut = graph.cut(cut.join(_roots(pieces, parts, common, start, end), "tree_id").withColumnRenamed("tree_id", "left"))
    # the lineage's ancestors on the right, up to the first that the left tree has, or that its root leads to
    asked = cut.select("pos", "node").union(cut.select("pos", "root")).distinct()
    above = graph.cut(asked.join(every, "node").where("s <= pos and pos < e").select("pos", "node", "to", "depth").distinct())
    above = graph.cut(above.join(_held(above.withColumnRenamed("pos", "tree_id"), pieces, common, "to").withColumnRenamed("tree_id", "pos"), ["pos", "to"]))
    ways = graph.cut(cut.join(above, ["pos", "node"]))
    known = _held(ways.withColumnRenamed("left", "tree_id"), pieces, common, "to").select(F.col("tree_id").alias("left"), "to", F.lit(True).alias("known"))
    over = above.select("pos", F.col("node").alias("root"), "to", F.lit(True).alias("over"))
    ways = ways.join(known, ["left", "to"], "left").join(over, ["pos", "root", "to"], "left").where("known OR over")
    first = ways.groupBy("left", "pos", "node", "rtime", "root").agg(F.min_by(F.struct("to", "known"), "depth").alias("m"))
    first = graph.cut(first.select("left", "pos", "rtime", "node", F.when(F.col("m.known"), F.col("m.to")).otherwise(F.col("root")).alias("to"), F.col("m.to").alias("name")))
    # down over nodes of one child: it has as many leaves below it as they have but themselves
    genes = arg.where("event = 'gene'").select(F.col("name").alias("node"), F.lit(1).alias("_own")).distinct()
    inner = pieces.select("node", "n", "s", "e").join(genes, "node", "left").withColumn("n", F.col("n") - F.coalesce("_own", F.lit(0))).where("n > 0")
    child = pieces.where("parent is not null").select(F.col("node").alias("_child"), F.col("parent").alias("node"), "n", F.col("s").alias("_s"), F.col("e").alias("_e"))
    single = child.join(inner, ["node", "n"]).where("s < _e and _s < e")
    down = _ways(graph.cut(single.select("node", F.col("_child").alias("parent"), F.greatest("s", "_s").alias("s"), F.least("e", "_e").alias("e"))))
    have = first.select("left", F.col("node").alias("have")).union(first.select("left", "to")).distinct()
    low = have.join(down.where("depth > 0").select(F.col("node").alias("have"), "ancestor", "depth", "s", "e"), "have").where("s <= left and left < e")
    low = low.groupBy("left", "have").agg(F.max_by("ancestor", "depth").alias("low"))
    low = graph.cut(have.join(low, ["left", "have"], "left").select("left", F.col("have").alias("ancestor"), F.coalesce("low", "have").alias("low")))
    for have, want in (("node", "rnode"), ("to", "cnode")):
        first = first.join(low.select("left", F.col("ancestor").alias(have), F.col("low").alias(want)), ["left", have])
    return first.join(arg.select("name", F.col("age").alias("ctime")), "name").select("pos", "rnode", "rtime", "cnode", "ctime")


def rearranged(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """The trees (tree_id, node, parent, age) after one move each (tree_id, rnode, cnode, ctime, name).

    The branch above rnode goes to a new node `name` of age ctime above cnode;
    the parent it leaves is taken out, so its other child must be just one. A
    tree without a move, or with one from a node to itself, stays as it is.
    """
    up = nodes.select("tree_id", "node", "parent")
    m = moves.where("rnode <> cnode").select("tree_id", "rnode", "cnode", "ctime", F.col("name").alias("new"))
    for of, out in (("rnode", "broken"), ("broken", "over"), ("cnode", "above")):
        m = m.join(up.select("tree_id", F.col("node").alias(of), F.col("parent").alias(out)), ["tree_id", of], "left")
    broken = F.col("broken")
    rows = nodes.join(m, "tree_id", "left").where(broken.isNull() | (F.col("node") != broken))
    moved = (F.col("node") == F.col("rnode")) | (F.col("node") == F.col("cnode")) | ((F.col("parent") == broken) & (F.col("cnode") == broken))
    parent = F.when(moved, F.col("new")).when(F.col("parent") == broken, F.col("over")).otherwise(F.col("parent"))
    top = F.when((F.col("above") == broken) | (F.col("cnode") == broken), F.col("over")).otherwise(F.col("above"))
    added = m.where(broken.isNotNull()).select("tree_id", F.col("new").alias("node"), top.alias("parent"), F.col("ctime").alias("age"))
    return rows.select("tree_id", "node", parent.alias("parent"), "age").unionByName(added)


def lineages(events: DataFrame, by: list[str], order: list[str], event: str, k: int) -> DataFrame:
    """Adds `lineages`: k less every meeting and plus every recombination so far."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    bad = F.raise_error(F.concat(F.lit("unknown event "), F.col(event)))
    step = F.when(F.col(event) == "coal", -1).when(F.col(event) == "recomb", 1).otherwise(bad.cast("int"))
    return events.withColumn("lineages", F.sum(step).over(w) + k)


def site_splits(mutations: DataFrame, leaves: DataFrame) -> DataFrame:
    """(site, side, other): carriers and the other leaves of every site, as sorted arrays. leaves is the (node) of one graph."""
    all_ = leaves.agg(F.array_sort(F.collect_list("node")).alias("all"))
    return mutations.join(F.broadcast(all_)).select("site", F.array_sort("carriers").alias("side"), F.array_sort(F.array_except("all", "carriers")).alias("other"))


def alignment_splits(aln: DataFrame) -> DataFrame:
    """(aln_id, pos, side, other): the sequences of each of the two letters of a column; columns of more or fewer letters are left out."""
    from .align import letters

    per = letters(aln).groupBy("aln_id", "pos", "c").agg(F.array_sort(F.collect_list("name")).alias("s"))
    two = per.groupBy("aln_id", "pos").agg(F.array_sort(F.collect_list(F.struct(F.size("s").alias("n"), "s"))).alias("x")).where("size(x) = 2")
    return two.select("aln_id", "pos", F.col("x")[0]["s"].alias("side"), F.col("x")[1]["s"].alias("other"))
