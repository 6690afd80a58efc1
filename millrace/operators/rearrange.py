"""Choosing roots, rearranging trees, and what reconciliations imply along branches.

What concerns a single tree (roots, moves, searches, enumeration) works on a
Tree and runs for a forest through trees.each_tree; the rest are joins over
all trees at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.population import log_labelled_histories, prob_coal_counts
from ..functions.samplers import chance_of_counts
from ..functions.special import log_factorial
from . import clumps, graph, trees
from .trees import ID, Tree


class Lineage:
    """Ways upwards in a species tree: common ancestors, and the losses passed on a way."""

    def __init__(self, species: Tree):
        self.tree, self.depth = species, {}
        for s in species.preorder():
            up = species.parent[s]
            self.depth[s] = 0 if up is None else self.depth[up] + 1

    def meet(self, a, b):
        up = self.tree.parent
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = up[a]
            else:
                b = up[b]
        return a

    def lost(self, low, top, dup: bool) -> int:
        """Species branches lost on a gene branch from low up to top."""
        if low == top:
            return 0
        n, up = 0, self.tree.parent
        s = up[low]
        while s != top:
            n, s = n + len(self.tree.kids[s]) - 1, up[s]
        return n + (len(self.tree.kids[top]) - 1 if dup else 0)


class Routes(Lineage):
    """A Lineage of species that are told by their routes, tuples of (head, level, passed, last) from the root down (trees.Numbered), so it needs no species tree."""

    def __init__(self):
        pass

    def meet(self, a, b):
        if a == b:
            return a
        at = None
        for i, (x, y) in enumerate(zip(a, b, strict=False)):
            if x[0] != y[0]:
                break
            at = a[: i + 1] if x[1] <= y[1] else b[: i + 1]
            if x[1] != y[1]:
                break
        if at is None:
            raise ValueError("species of two trees")
        return at

    def lost(self, low, top, dup: bool) -> int:
        return 0 if low == top else low[-1][2] - top[-1][2] - (0 if dup else top[-1][3])


def root_costs(t: Tree, species: Tree | Lineage, tips: dict) -> dict:
    """{node: (dups, losses)} for a root in the branch above each node; the two branches of a root of two children are one.

    A branch cuts the tree into two parts; species and events of a part don't
    depend on the rest, so every part is worked out once in each direction.
    No node may have a single child.
    """
    way = species if isinstance(species, Lineage) else Lineage(species)
    near = {n: list(t.kids[n]) + ([] if t.parent[n] is None else [t.parent[n]]) for n in t.parent}
    skip = t.root if len(t.kids[t.root]) == 2 else None
    if skip is not None:
        a, b = near.pop(skip)
        near[a] = [b if m == skip else m for m in near[a]]
        near[b] = [a if m == skip else m for m in near[b]]

    def joined(parts: list) -> tuple:
        at = parts[0][0]
        for s, _, _ in parts[1:]:
            at = way.meet(at, s)
        dup = any(s == at for s, _, _ in parts)
        dups = sum(d for _, d, _ in parts) + (len(parts) - 1 if dup else 0)
        return at, dups, sum(x + way.lost(s, at, dup) for s, _, x in parts)

    part: dict = {}

    def below(n, back) -> tuple:
        todo = [(n, back)]
        while todo:
            n_, b_ = todo[-1]
            rest = [(m, n_) for m in near[n_] if m != b_]
            wait = [r for r in rest if r not in part]
            if (n_, b_) in part or not wait:
                if (n_, b_) not in part:
                    part[n_, b_] = joined([part[r] for r in rest]) if rest else (tips[n_], 0, 0)
                todo.pop()
            else:
                todo += wait
        return part[n, back]

    out, seen = {}, set()
    for n in t.preorder():
        if n in (t.root, skip):
            continue
        up = t.parent[n] if t.parent[n] != skip else next(m for m in t.kids[skip] if m != n)
        if frozenset((n, up)) in seen:
            continue
        seen.add(frozenset((n, up)))
        out[n] = joined([below(n, up), below(up, n)])[1:]
    return out


def root_by_events(t: Tree, species: Tree | Lineage, tips: dict, dup: float = 1, loss: float = 1) -> Tree:
    """The tree with the root of fewest weighted duplications and losses.

    Of equal roots that is taken whose side without the first leaf has the
    smallest names, so the old root makes no difference. Nodes of one child are
    left out, as they part nothing.
    """
    t = trees.without_single(t) if any(len(k) == 1 for k in t.kids.values()) else t
    if len(t.leaves()) < 3:
        return t
    costs = {n: d * dup + x * loss for n, (d, x) in root_costs(t, species, tips).items()}
    least, names = min(costs.values()), set(t.leaves())
    first = min(names)

    def side(n):
        got, todo = set(), [n]
        while todo:
            k = todo.pop()
            todo += t.kids[k]
            if not t.kids[k]:
                got.add(k)
        return sorted(names - got if first in got else got)

    best = min((n for n, c in costs.items() if c == least), key=side)
    return t if t.parent[best] == t.root and len(t.kids[t.root]) == 2 else trees.reroot(t, best)


# Moves


def swapped(t: Tree, a, b) -> Tree:
    """The tree with the parts below a and b, neither within the other, in each other's place, with their branches."""
    to = {a: t.parent[b], b: t.parent[a]}
    return Tree([(n, to.get(n, p), d) for n, p, d in t.rows()])


def nni_moves(t: Tree, rooted: bool = True) -> list[tuple]:
    """Pairs to swap for the nearest neighbours: a child of an inner node with a sister of that node.

    Unrooted, the two branches of a root of two children are one branch, whose
    ends' children are swapped.
    """
    out = []
    for v in t.preorder():
        up = t.parent[v]
        if up is None or not t.kids[v]:
            continue
        sisters = [s for s in t.kids[up] if s != v]
        if not rooted and up == t.root and len(sisters) == 1:
            if v != t.kids[up][0] or not t.kids[sisters[0]]:
                continue
            # one child stays: swapping the others gives every neighbour once
            sisters = t.kids[sisters[0]][1:] if len(t.kids[v]) == 2 else t.kids[sisters[0]]
        out += [(c, s) for c in t.kids[v] for s in sisters]
    return out


def regrafted(t: Tree, node, to) -> Tree:
    """The part below node cut off and hung into the middle of the branch above `to`, which isn't within it."""
    joint = "joint"
    while joint in t.parent:
        joint += "_"
    rows = []
    for n, p, d in t.rows():
        if n == to:
            rows += [(joint, p, d / 2), (n, joint, d / 2 if p is not None else 0.0)]
        else:
            rows.append((n, joint if n == node else p, d))
    got = Tree(rows)
    return trees.without_single(got)


def spr_moves(t: Tree) -> list[tuple]:
    """(node, to) of every cut and regraft that changes the tree."""
    out = []
    for n in t.preorder():
        if n == t.root:
            continue
        inside, todo = set(), [n]
        while todo:
            k = todo.pop()
            inside.add(k)
            todo += t.kids[k]
        up = t.parent[n]
        still = {up, *t.kids[up]} if len(t.kids[up]) == 2 else set()
        out += [(n, m) for m in t.preorder() if m not in inside and m not in still]
    return out


def search(t: Tree, score: Callable[[Tree], float], steps: int, seed: int, prescreen: Callable[[Tree], float] | None = None, batch: int = 1) -> tuple[Tree, float]:
    """Hill climbing by random moves, half of them swaps and half regrafts: the best tree seen and its score.

    Every step draws `batch` moves, takes the one of the best prescreen value,
    and goes there if it scores no worse. Topologies seen before aren't scored again.
    """
    rng = np.random.default_rng(seed)
    best, top, seen = t, score(t), {trees.topology(t)}
    for _ in range(steps):
        drawn = []
        for _ in range(batch):
            near = rng.random() < 0.5
            moves = nni_moves(best) if near else spr_moves(best)
            if moves:
                a, b = moves[rng.integers(len(moves))]
                drawn.append(swapped(best, a, b) if near else regrafted(best, a, b))
        if not drawn:
            continue
        new = max(drawn, key=prescreen) if prescreen else drawn[0]
        if (key := trees.topology(new)) in seen:
            continue
        seen.add(key)
        if (got := score(new)) >= top:
            best, top = new, got
    return best, top


def reconciliations(t: Tree, species: Tree, tips: dict, depth: int | None = None) -> Iterator[dict]:
    """Every {node: (species, event)} that is at most `depth` steps above the most parsimonious one.

    A step makes a speciation a duplication, or moves a duplication up by one
    species branch, though never above that of the node's parent.
    """
    way = Lineage(species)
    low = t.fold(lambda n, got: tips[n] if not got else _meet_all(way, got))
    order = t.preorder()

    def choices(n, top):
        if not t.kids[n]:
            yield (low[n], "gene"), 0
            return
        cost, s = 0, low[n]
        if all(low[k] != s for k in t.kids[n]):
            yield (s, "spec"), 0
            cost = 1
        while True:
            yield (s, "dup"), cost
            if s == top or species.parent[s] is None:
                return
            s, cost = species.parent[s], cost + 1

    def rest(i, taken, used):
        if i == len(order):
            yield dict(taken)
            return
        n = order[i]
        up = t.parent[n]
        for pick, cost in choices(n, None if up is None else taken[up][0]):
            if depth is not None and used + cost > depth:
                break
            taken[n] = pick
            yield from rest(i + 1, taken, used + cost)
        taken.pop(n, None)

    yield from rest(0, {}, 0)


def _meet_all(way: Lineage, parts: list):
    at = parts[0]
    for s in parts[1:]:
        at = way.meet(at, s)
    return at


def rooted_forest(nodes: DataFrame, species: DataFrame, tips: DataFrame, dup: float = 1, loss: float = 1) -> DataFrame:
    """root_by_events() of every tree; a tree must fit in a task, the species tree needn't."""
    text = lambda df, *cols: df.select(*(F.col(c).cast("string").alias(c) for c in cols))
    marked = trees.Numbered(text(species, "node", "parent"), lost=True).mark(text(tips, "tree_id", "node", "species"))
    return rooted_packed(clumps.pack(trees._as_text(nodes).join(marked, ID, "left")), dup, loss)


#: Species whose routes a task keeps as tuples.
KEPT = 20_000


def rooted_packed(nodes: DataFrame, dup: float = 1, loss: float = 1) -> DataFrame:
    """rooted_forest() of packed trees whose leaves have `pre` and `route` of their species (trees.Numbered with lost); nothing is dealt."""

    def task(batches):
        way, kept = Routes(), {}
        for batch in batches:
            own = batch.column("own")
            flat = own.flatten()
            names, parents, dist, pre = (flat.field(c).to_pylist() for c in ("node", "parent", "dist", "pre"))
            route, out = flat.field("route"), []
            if len(kept) > KEPT:
                kept.clear()
            first = {}
            for i, p in enumerate(pre):
                if p is not None and p not in kept:
                    first.setdefault(p, i)
            for p, r in zip(first, route.take(pa.array(list(first.values()), pa.int64())).to_pylist(), strict=True):
                kept[p] = tuple((x["head"], x["level"], x["passed"], x["last"]) for x in r)
            start = 0
            for tree_id, size in zip(batch.column("tree_id").to_pylist(), pc.list_value_length(own).to_pylist(), strict=True):
                end = start + size
                rows = sorted(set(zip(names[start:end], parents[start:end], dist[start:end], strict=True)), key=lambda r: r[0])
                at = {n: kept[p] for n, p in zip(names[start:end], pre[start:end], strict=True) if p is not None}
                t = root_by_events(Tree(rows), way, at, dup, loss)
                out += [(tree_id, *r) for r in t.rows()]
                start = end
            cols = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(),) * 3 + (pa.float64(),), strict=True)], ["tree_id", "node", "parent", "dist"])

    own = F.transform("own", lambda n: F.struct(*(n[c].cast("string").alias(c) for c in ("node", "parent")), *(n[c].alias(c) for c in ("dist", "pre", "route"))))
    return nodes.select(F.col("tree_id").cast("string").alias("tree_id"), own.alias("own")).mapInArrow(task, trees.NODES)


# Joins over all trees


def branch_events(nodes: DataFrame, species: DataFrame, recon: DataFrame) -> DataFrame:
    """(tree_id, node, k, snode, event): what a gene branch passes on its way down, from 0: `specloss`es, then the node's own event.

    A branch from a speciation starts below its species, one from a duplication within it.
    """
    up = graph.closure(species).select(F.col("node").alias("low"), F.col("ancestor").alias("s"), "depth")
    span = up.select("low", F.col("s").alias("ps"), F.col("depth").alias("span"))
    own = trees.branches(nodes, recon).withColumnRenamed("snode", "low").join(span, ["low", "ps"], "left")
    last = F.coalesce(F.col("span") - F.when(F.col("pe") == "dup", 0).otherwise(1), F.lit(0))
    # no branch passes fewer than none: a child within a speciation's own species has its event alone
    own = own.withColumn("last", F.greatest(last, F.lit(0)))
    steps = own.join(up, "low").where("depth <= last")
    event = F.when(F.col("depth") == 0, F.col("event")).otherwise("specloss")
    return steps.select(*ID, (F.col("last") - F.col("depth")).cast("int").alias("k"), F.col("s").alias("snode"), event.alias("event"))


def species_roots(nodes: DataFrame, species: DataFrame, recon: DataFrame) -> DataFrame:
    """(tree_id, node): the lowest gene nodes that belong to the root of the species tree."""
    top = F.broadcast(species.where("parent is null").select(F.col("node").alias("snode")))
    mine = lambda r: r.join(top, "snode").select(*ID)
    if isinstance(recon, trees.Reconciled) and (at := recon.top()) is not None:
        return recon.by_size(lambda n, _: clumps.run(n, clumps.species_roots(at), trees._kinds(n, "node")), lambda n, r: _far_roots(n, mine(r)))
    at = mine(trees.as_rows(recon))
    return trees.by_size(nodes, lambda n, x: clumps.run(n, clumps.species_roots(), trees._kinds(n, "node"), x), _far_roots, at)


def _far_roots(nodes: DataFrame, at: DataFrame) -> DataFrame:
    above = trees.paths(nodes).where("depth > 0").join(at, ID).select("tree_id", F.col("ancestor").alias("node")).distinct()
    return at.join(above, ID, "left_anti")


def split_early(nodes: DataFrame, species: DataFrame, recon: DataFrame) -> DataFrame:
    """(tree_id, part, node, parent): trees cut apart at duplications older than all species; a part is named by its root.

    The duplications cut are those in the species root that have nothing but such ones above them.
    """
    top = F.broadcast(species.where("parent is null").select(F.col("node").alias("snode")))
    mine = lambda r: r.where("event = 'dup'").join(top, "snode").select(*ID)
    if isinstance(recon, trees.Reconciled) and (at := recon.top()) is not None:
        return recon.by_size(lambda n, _: clumps.run(n, clumps.split_early(at), trees._kinds(n, "part", "node", "parent")), lambda n, r: _far_parts(n, mine(r)))
    early = mine(trees.as_rows(recon))
    return trees.by_size(nodes, lambda n, x: clumps.run(n, clumps.split_early(), trees._kinds(n, "part", "node", "parent"), x), _far_parts, early)


def _far_parts(nodes: DataFrame, early: DataFrame) -> DataFrame:
    whole = nodes.select("tree_id", "node", "parent").join(early.withColumn("cut", F.lit(1)), ID, "left")
    up = trees.paths(nodes).join(whole.select("tree_id", F.col("node").alias("ancestor"), "cut"), ["tree_id", "ancestor"])
    # recon is monotone: below a node that isn't cut there may be such duplications, but they stay
    part = up.where("cut is null").groupBy(*ID).agg(F.max_by("ancestor", "depth").alias("part"))
    return nodes.select("tree_id", "node", "parent").join(part, ID).select("tree_id", "part", "node", F.when(F.col("node") != F.col("part"), F.col("parent")).alias("parent"))


def lineages(nodes: DataFrame, species: DataFrame, recon: DataFrame) -> DataFrame:
    """(tree_id, snode, low, high): gene lineages at the bottom and the top of each species branch that has any.

    The bottom has the leaves below less what met below; the top lacks also
    what met in the branch. A node of k children takes k - 1 lineages.
    """
    met = F.when(F.col("k") > 0, F.col("k") - 1)
    per = lambda rows: rows.groupBy("tree_id", "snode").agg(F.count_if(F.col("k") == 0).alias("tips"), F.coalesce(F.sum(met), F.lit(0)).alias("met"))
    up = graph.closure(species).select(F.col("node").alias("snode"), "ancestor", "depth")
    if isinstance(recon, trees.Reconciled):
        at = recon.by_size(lambda n, r: r.named(clumps.run(n, clumps.lineages, f"{trees._kinds(n)}, snode long, tips long, met long"), "snode"), lambda n, r: per(trees.branches(n, r)))
        up = F.broadcast(up) if up.count() <= trees.NEAR else up
    else:
        at = per(trees.branches(nodes, recon))
    got = at.join(up, "snode").groupBy("tree_id", F.col("ancestor").alias("snode"))
    own = F.when(F.col("depth") == 0, F.col("met")).otherwise(0)
    out = got.agg(F.sum("tips").alias("t"), F.sum("met").alias("m"), F.sum(own).alias("own"))
    return out.select("tree_id", "snode", (F.col("t") - F.col("m") + F.col("own")).alias("low"), (F.col("t") - F.col("m")).alias("high"))


def multispecies_log_prob(nodes: DataFrame, species: DataFrame, recon: DataFrame, n: Column) -> DataFrame:
    """(tree_id, log_p): the chance of a binary gene tree and its reconciliation under the coalescent in the species tree.

    species has (node, parent, dist); n is a column over it, the population of
    a branch. The root branch has no end.
    """
    inner = nodes.where("parent is not null").select("tree_id", F.col("parent").alias("node")).distinct().join(recon.select(*ID, "snode"), ID)
    ways = trees.paths(nodes).join(inner, ID).withColumnsRenamed({"snode": "s"})
    tops = inner.select("tree_id", F.col("node").alias("ancestor"), F.col("snode").alias("top"))
    under = ways.join(tops, ["tree_id", "ancestor"]).where("s = top").groupBy("tree_id", "ancestor").agg(F.log(F.count("*")).alias("l"))
    orders = under.groupBy("tree_id").agg(F.sum("l").alias("orders"))
    per = inner.groupBy("tree_id", "snode").agg(F.count("*").alias("met"))
    root = F.col("up").isNull()
    sp = species.select(F.col("node").alias("snode"), F.col("parent").alias("up"), F.col("dist").cast("double").alias("t"), n.cast("double").alias("n"))
    b = lineages(nodes, species.select("node", "parent"), recon).where("low > 0").join(sp, "snode").join(per, ["tree_id", "snode"], "left")
    high = F.when(root, F.lit(1)).otherwise(F.col("high"))
    stay = F.when(root, 0.0).otherwise(F.log(prob_coal_counts(F.col("low"), F.col("high"), F.col("t"), F.col("n"))))
    each = stay + log_factorial(F.coalesce("met", F.lit(0)).cast("double")) - log_labelled_histories(F.col("low"), high)
    return b.groupBy("tree_id").agg(F.sum(each).alias("p")).join(orders, "tree_id", "left").select("tree_id", (F.col("p") - F.coalesce("orders", F.lit(0.0))).alias("log_p"))


def log_met_before(counts: DataFrame, species: DataFrame, until: float | None) -> DataFrame:
    """(tree_id, log_p): the chance that the lineages (tree_id, snode, n) at the leaves of a species tree have one ancestor by `until`.

    species has (node, parent, age, n), n being the population of the branch
    above, and goes to the tasks whole (at most 100,000 nodes); each family is a row there. From the
    leaves up a branch has a chance for every number of lineages. A leaf without
    a count has none; without `until` the root's branch has no end.
    """
    import pandas as pd

    rows = species.select("node", "parent", F.col("age").cast("double"), F.col("n").cast("double")).limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("a tree of more than 100000 nodes doesn't go to the tasks")
    ages, pops = {r.node: r.age for r in rows}, {r.node: r.n for r in rows}
    kids: dict = {}
    for r in rows:
        kids.setdefault(r.parent, []).append(r.node)
    order = list(kids[None])
    for node in order:
        order.extend(kids.get(node, []))
    above = {r.node: r.parent for r in rows}

    def chance(leaves: dict) -> float:
        tops: dict = {}
        for node in reversed(order):
            start = np.ones(1)
            if node not in kids:
                start = np.zeros(int(leaves.get(node, 0)) + 1)
                start[-1] = 1.0
            for kid in kids.get(node, []):
                start = np.convolve(start, tops.pop(kid))
            most, up = len(start) - 1, above[node]
            end = ages[up] if up is not None else until
            if most == 0:
                tops[node] = start
            elif end is None:
                tops[node] = np.array([start[0], start[1:].sum()])
            else:
                moved = [sum(start[a] * chance_of_counts(a, b, end - ages[node], pops[node]) for a in range(b, most + 1)) for b in range(1, most + 1)]
                tops[node] = np.array([start[0], *moved])
        top = tops[order[0]]
        return float(top[1]) if len(top) > 1 else 1.0

    def run(batches):
        for pdf in batches:
            with np.errstate(divide="ignore"):
                yield pd.DataFrame({"tree_id": pdf["tree_id"], "log_p": [float(np.log(chance({r["snode"]: r["n"] for r in m}))) for m in pdf["m"]]})

    each = counts.groupBy("tree_id").agg(F.collect_list(F.struct("snode", F.col("n").cast("long").alias("n"))).alias("m"))
    return each.mapInPandas(run, f"tree_id {counts.schema['tree_id'].dataType.simpleString()}, log_p double")


def duplication_consistency(nodes: DataFrame, recon: DataFrame) -> DataFrame:
    """(tree_id, node, consistency): of the species below a duplication, the share that more than one of its children leads to."""
    small = lambda n, r: clumps.run(n, clumps.consistency, f"{trees._kinds(n, 'node')}, consistency double", trees._recon_beside(r))
    return trees.by_size(nodes, small, _far_consistency, recon)


def _far_consistency(nodes: DataFrame, recon: DataFrame) -> DataFrame:
    at = recon.where("event = 'dup'").select(*ID)
    kids = nodes.select("tree_id", F.col("node").alias("side"), F.col("parent").alias("node")).join(at, ID)
    tips = recon.where("event = 'gene'").select(*ID, "snode")
    below = trees.paths(nodes).join(tips, ID).select("tree_id", F.col("ancestor").alias("side"), "snode").distinct()
    per = kids.join(below, ["tree_id", "side"]).groupBy(*ID, "snode").agg(F.count("*").alias("n"))
    return per.groupBy(*ID).agg((F.count_if(F.col("n") > 1) / F.count("*")).alias("consistency"))


def relabelled(recon: DataFrame, consistency: DataFrame) -> DataFrame:
    """recon with duplications of consistency 0 made speciations: no species shows that there were two genes."""
    none = consistency.where("consistency = 0").select(*ID, F.lit(1).alias("_none"))
    return recon.join(none, ID, "left").withColumn("event", F.when(F.col("_none") == 1, "spec").otherwise(F.col("event"))).drop("_none")
