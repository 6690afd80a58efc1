"""Many whole trees at once in a task, as arrays over all their nodes.

A forest has one row a tree, with a list of its nodes (pack()); a task takes the trees of some thousand
nodes together, so that neither Python nor a shuffle does anything once a node, and what was packed is never dealt again. Trees of more than
MOST nodes don't come here: trees.py joins them over the whole forest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes of a tree that a task takes in arrays; its pairs are half the square of this.
MOST = 1000
#: Nodes of the trees that are worked out at once, and pairs of nodes in them.
GATHER, PAIRS = 50_000, 4_000_000


class Clump:
    """Whole trees, one a row of the batch: `own` has their nodes' rows, `beside` those laid beside nodes, which may also be further fields of `own`; `up` is the parent's place (-1 at a root), `dist` the branch.

    Repeated rows count once, a node of two parents and a cycle are errors, and a parent without a
    row counts as none. Nodes of a tree are together, in the order of their names.
    """

    def __init__(self, batch: pa.RecordBatch):
        own, at = _flat(batch, "own")
        mixed = "beside" not in batch.schema.names
        if not mixed:
            beside, at_beside = _flat(batch, "beside")
        elif len(own.column_names) > 3:
            # what is laid beside a node is in its own row
            has = pc.is_valid(own.column(3))
            beside, at_beside = own.filter(has), at[has.to_numpy()]
        else:
            beside, at_beside = own.slice(0, 0), at[:0]
        names = pa.chunked_array([*own["node"].chunks, *own["parent"].chunks, *beside["node"].chunks], own.schema.field("node").type).combine_chunks()
        self.names, code = _coded(names)
        self.trees = batch.column("tree_id")
        n = own.num_rows
        width = len(self.names) + 1
        key = at * width + code[:n]
        order = np.argsort(key, kind="stable")
        parent = np.where(code[n : 2 * n] < 0, -1, at * width + code[n : 2 * n])[order]
        key = key[order]
        first = np.ones(n, dtype=bool)
        first[1:] = key[1:] != key[:-1]
        if (~first[1:] & (parent[1:] != parent[:-1])).any():
            raise ValueError("a node has two parents")
        self.key, order, parent = key[first], order[first], parent[first]
        self.n, self.width = len(self.key), width
        self.up = self.place(parent)
        self.of, self.code = self.key // width, self.key % width
        dist = pc.fill_null(pc.cast(own["dist"], pa.float64()), 0.0).to_numpy()
        self.dist = dist[order]
        self.kids = np.bincount(self.up[self.up >= 0], minlength=self.n)
        self.leaf = self.kids == 0
        where = self.place(at_beside * width + code[2 * n :])
        self.beside, self.at = (beside if (where >= 0).all() else beside.filter(pa.array(where >= 0))), where[where >= 0]
        self.level = self.climb(lambda level, at: np.add.at(level, at, 1), np.zeros(self.n, dtype=np.int64)) - 1

    def place(self, key: np.ndarray) -> np.ndarray:
        """The nodes' places of keys, -1 where there is none."""
        if not self.n:
            return np.full(len(key), -1)
        i = np.minimum(np.searchsorted(self.key, key), self.n - 1)
        return np.where(self.key[i] == key, i, -1)

    def steps(self, start: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, ancestor) places, first of depth 0, then of depth 1, and so on."""
        low = np.arange(self.n) if start is None else start
        at = low
        for _ in range(self.n + 1):
            if not len(at):
                return
            yield low, at
            up = self.up[at]
            low, at = low[up >= 0], up[up >= 0]
        raise ValueError("the table has a cycle")

    def climb(self, f: Callable, out: np.ndarray) -> np.ndarray:
        for low, _ in self.steps():
            f(out, low)
        return out

    def high(self) -> np.ndarray:
        """The lengths from above the root down to each node."""
        out = np.zeros(self.n)
        for low, at in self.steps():
            out[low] += self.dist[at]
        return out

    def closure(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (start, ancestor) places."""
        got = list(self.steps(start))
        return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (start, start)

    def pairs(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, lca) of the places `of` (ascending), a before b, that have a common ancestor."""
        tree = self.of[of]
        last = np.searchsorted(tree, tree, side="right")
        n = last - np.arange(len(of)) - 1
        i = np.repeat(np.arange(len(of)), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        a, b = of[i], of[j]
        x, y = a.copy(), b.copy()
        open_ = np.arange(len(a))
        while len(open_):
            open_ = open_[(x[open_] != y[open_]) & (x[open_] >= 0) & (y[open_] >= 0)]
            p, q = x[open_], y[open_]
            deep = self.level[p] - self.level[q]
            x[open_], y[open_] = np.where(deep >= 0, self.up[p], p), np.where(deep <= 0, self.up[q], q)
        met = (x == y) & (x >= 0)
        return a[met], b[met], x[met]

    def table(self, at: np.ndarray, **columns) -> pa.Table:
        """tree_id of the places, and columns; an integer array stands for the names of places where its name is node, a, b, parent, part or side."""
        out = {"tree_id": self.trees.take(pa.array(self.of[at]))}
        for name, x in columns.items():
            named = name in ("node", "a", "b", "parent", "part")
            out[name] = self.named(x) if named else x if isinstance(x, pa.Array) else pa.array(x)
        return pa.table(out)

    def named(self, at: np.ndarray) -> pa.Array:
        return self.names.take(pa.array(np.where(at >= 0, self.code[at] if self.n else at, 0), mask=at < 0))

    def lists(self, at: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """Lists of names from their places one after the other."""
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), self.named(at))


def _coded(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct values in order and each value's number in it, -1 for null."""
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    index = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary.take(pa.array(order)), np.where(index >= 0, rank[index] if len(rank) else -1, -1)


def pack(rows: DataFrame, name: str = "own") -> DataFrame:
    """(tree_id, own): one row a tree, with a list of its rows. What is dealt by tree already isn't dealt again."""
    rows = rows.where("tree_id is not null and node is not null")
    return rows.groupBy("tree_id").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "tree_id"))).alias(name))


def is_packed(nodes: DataFrame) -> bool:
    return "own" in nodes.columns


def unpack(nodes: DataFrame) -> DataFrame:
    return nodes.select("tree_id", F.inline("own")).select("tree_id", "node", "parent", "dist") if is_packed(nodes) else nodes


def run(nodes: DataFrame, f: Callable, schema: str, beside: DataFrame | None = None, make: Callable = Clump) -> DataFrame:
    """f of all trees of (tree_id, node, parent, dist) or pack() of it, some at a time; rows of `beside` (tree_id, node, ...) go to the task of their tree. f gets make() of a batch of trees."""
    if not is_packed(nodes):
        dist = F.col("dist").cast("double") if "dist" in nodes.columns else F.lit(None).cast("double")
        nodes = pack(nodes.select("tree_id", "node", "parent", dist.alias("dist")))
    if beside is not None:
        nodes = nodes.join(pack(beside, "beside"), "tree_id", "left")

    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = sum(pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("own", "other") if c in batch.schema.names)
            group = np.maximum(np.cumsum(sizes * sizes) // PAIRS, np.cumsum(sizes) // GATHER)
            # a group ends where either bound is passed
            cuts = [*(np.flatnonzero(group[1:] != group[:-1]) + 1), batch.num_rows]
            start = 0
            for end in cuts:
                got = f(make(batch.slice(start, end - start)))
                yield from got.combine_chunks().to_batches(max_chunksize=100_000)
                start = end

    return nodes.mapInArrow(task, schema)


def _flat(batch: pa.RecordBatch, name: str) -> tuple[pa.Table, np.ndarray]:
    """The rows of all lists, and each one's place in the batch."""
    lists = batch.column(name)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.Table.from_struct_array(lists.flatten()), np.repeat(np.arange(len(sizes)), sizes)


def kind(df: DataFrame, column: str) -> str:
    fields = df.schema if column in df.columns else df.schema["own"].dataType.elementType
    return fields[column].dataType.simpleString()


# What is worked out in a clump


def leaf_distances(c: Clump) -> pa.Table:
    a, b, top = c.pairs(np.flatnonzero(c.leaf))
    high = c.high()
    return c.table(a, a=a, b=b, distance=high[a] + high[b] - 2 * high[top])


def ages(c: Clump) -> pa.Table:
    high = c.high()
    far, near = np.full(c.n, -np.inf), np.full(c.n, np.inf)
    for low, at in c.steps(np.flatnonzero(c.leaf)):
        np.maximum.at(far, at, high[low])
        np.minimum.at(near, at, high[low])
    at = np.arange(c.n)
    return c.table(at, node=at, age=far - high, spread=far - near)


def with_distances(c: Clump) -> pa.Table:
    """The trees packed again, with the leaf_distances() of each tree beside it: `beside` has (node, b, distance)."""
    a, b, top = c.pairs(np.flatnonzero(c.leaf))
    high = c.high()
    order = np.argsort(c.of[a], kind="stable")
    a, b, top = a[order], b[order], top[order]
    cells = pa.StructArray.from_arrays([c.named(a), c.named(b), pa.array(high[a] + high[b] - 2 * high[top])], ["node", "b", "distance"])
    return pa.table({"tree_id": c.trees, "own": packed_again(c, c.dist), "beside": pa.ListArray.from_arrays(_ends(c.of[a], len(c.trees)), cells)})


def packed_again(c: Clump, dist: np.ndarray) -> pa.Array:
    place = np.arange(c.n)
    own = pa.StructArray.from_arrays([c.named(place), c.named(c.up), pa.array(dist)], ["node", "parent", "dist"])
    return pa.ListArray.from_arrays(_ends(c.of, len(c.trees)), own)


def _ends(of: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n)))).astype(np.int32))


def fitted(weighted: bool, non_negative: bool) -> Callable[[Clump], pa.Table]:
    """Trees with the lengths of trees.fitted_lengths() for the distances beside them; trees of one shape are solved together."""

    def f(c: Clump) -> pa.Table:
        tree = c.of[c.at]
        to = pc.fill_null(pc.index_in(c.beside["b"], value_set=c.names), -1).to_numpy().astype(np.int64)
        to = c.place(np.where(to < 0, -1, tree * c.width + to))
        far = pc.cast(c.beside["distance"], pa.float64())
        on = c.leaf[c.at] & (to >= 0) & (to != c.at) & far.is_valid().to_numpy()
        on &= c.leaf[np.maximum(to, 0)] if c.n else False
        a, b, far, tree = np.minimum(c.at, to)[on], np.maximum(c.at, to)[on], far.to_numpy()[on], tree[on]
        _, once = np.unique(a * max(1, c.n) + b, return_index=True)
        a, b, far, tree = a[once], b[once], far[once], tree[once]
        ends, pair_ends = (np.concatenate(([0], np.cumsum(np.bincount(x, minlength=len(c.trees))))) for x in (c.of, tree))
        start = ends[:-1]
        up = np.where(c.up >= 0, c.up - start[c.of], -1)
        pairs = np.stack((a - start[tree], b - start[tree]), axis=1)
        shapes: dict = {}
        for i in np.flatnonzero(np.diff(pair_ends)).tolist():
            shapes.setdefault((up[ends[i] : ends[i + 1]].tobytes(), pairs[pair_ends[i] : pair_ends[i + 1]].tobytes()), []).append(i)
        dist = c.dist.copy()
        for like in shapes.values():
            i, many = like[0], np.array(like)
            own, ij = up[ends[i] : ends[i + 1]], pairs[pair_ends[i] : pair_ends[i + 1]]
            within = np.eye(len(own), dtype=bool)
            at = own.copy()
            while (go := np.flatnonzero(at >= 0)).size:
                within[go, at[go]] = True
                at[go] = own[at[go]]
            edges = np.flatnonzero(own >= 0)
            crossed = (within[ij[:, 0]] != within[ij[:, 1]])[:, edges].astype(float)
            d = far[pair_ends[many][None, :] + np.arange(len(ij))[:, None]]
            if weighted:
                got = np.stack([_weighted(crossed, x) for x in d.T], axis=1)
            else:
                got = np.linalg.lstsq(crossed, d, rcond=None)[0]
            dist[start[many][None, :] + np.flatnonzero(own < 0)[:, None]] = 0.0
            dist[start[many][None, :] + edges[:, None]] = np.maximum(got, 0.0) if non_negative else got
        return pa.table({"tree_id": c.trees, "own": packed_again(c, dist)})

    return f


def _weighted(crossed: np.ndarray, far: np.ndarray) -> np.ndarray:
    root = np.sqrt(far)[:, None]
    return np.linalg.lstsq(np.divide(crossed, root, out=np.zeros_like(crossed), where=root > 0), root[:, 0], rcond=None)[0]


def splits_of_both(rooted: bool) -> Callable[[pa.RecordBatch], pa.Table]:
    """Of trees `own` and `other` in a row: lists x and y of their splits (side, other)."""

    def one(c: Clump) -> pa.Array:
        at, side, other = _splits(c, rooted)
        return pa.ListArray.from_arrays(_ends(c.of[at], len(c.trees)), pa.StructArray.from_arrays([side, other], ["side", "other"]))

    def f(batch: pa.RecordBatch) -> pa.Table:
        sides = [pa.RecordBatch.from_arrays([batch.column("tree_id"), batch.column(c)], ["tree_id", "own"]) for c in ("own", "other")]
        return pa.table({"tree_id": batch.column("tree_id"), "x": one(Clump(sides[0])), "y": one(Clump(sides[1]))})

    return f


def splits(rooted: bool) -> Callable[[Clump], pa.Table]:
    def f(c: Clump) -> pa.Table:
        at, side, other = _splits(c, rooted)
        return c.table(at, side=side, other=other)

    return f


def _splits(c: Clump, rooted: bool) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """The nodes below the branches that split, in order, and the names on both sides."""
    tips = np.flatnonzero(c.leaf)
    low, at = c.closure(tips)
    below = np.bincount(at, minlength=c.n)
    whole = np.bincount(c.of, weights=c.leaf, minlength=len(c.trees)).astype(np.int64)[c.of] if c.n else below
    up = c.up
    # a node whose only child holds the same leaves says it again, as do both branches of a top of two
    again = (up >= 0) & (below == below[up]) & (c.up[up] >= 0)
    out = (up >= 0) & ~again & (below > 1)
    if not rooted:
        out &= whole - below > 1
        twin = (up >= 0) & (below[up] == whole) & (c.kids[up] == 2)
        place = np.arange(c.n)
        latest = np.zeros(c.n, dtype=np.int64)
        np.maximum.at(latest, up[twin], place[twin])
        out &= ~(twin & (latest[up] == place))
    at_ = np.flatnonzero(out)
    # every node's tree's leaves, one after the other, and whether they are below it
    first = np.searchsorted(c.of[tips], c.of[at_])
    n = whole[at_]
    start = np.cumsum(n) - n
    leaf = tips[np.repeat(first - start, n) + np.arange(n.sum())]
    inside = np.zeros(n.sum(), dtype=bool)
    row = np.full(c.n, -1)
    row[at_] = np.arange(len(at_))
    rank = np.zeros(c.n, dtype=np.int64)
    rank[tips] = np.arange(len(tips))
    r = row[at]
    r, low = r[r >= 0], low[r >= 0]
    inside[start[r] + rank[low] - first[r]] = True
    k = below[at_]
    swap = np.zeros(len(at_), dtype=bool)
    if not rooted and len(at_):
        # of equal sides that with the smaller name comes first: the first leaf of the tree is in it
        swap = (2 * k > n) | ((2 * k == n) & ~inside[start])
    inside ^= np.repeat(swap, n)
    k = np.where(swap, n - k, k)
    return at_, c.lists(leaf[inside], k), c.lists(leaf[~inside], n - k)


def _recon(c: Clump) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """For each node: the number of its species and of its event, -1 without; with the values of both."""
    species, s = _coded(c.beside["snode"].combine_chunks() if c.beside.num_rows else pa.array([], c.beside.schema.field("snode").type))
    events, e = _coded(c.beside["event"].combine_chunks() if c.beside.num_rows else pa.array([], pa.string()))
    snode, event = np.full(c.n, -1), np.full(c.n, -1)
    snode[c.at], event[c.at] = s, e
    return snode, species, events, event


def _is(events: pa.Array, event: np.ndarray, name: str) -> np.ndarray:
    at = events.index(name).as_py()
    return (event == at) & (at >= 0)


def branches(c: Clump) -> pa.Table:
    """Each reconciled node with its number of children, and its parent's species and event."""
    snode, species, events, event = _recon(c)
    at = np.flatnonzero(event >= 0)
    up = c.up[at]
    top = np.where((up >= 0), up, 0)
    none = (up < 0) | (event[top] < 0)
    take = lambda values, i, mask: values.take(pa.array(np.where(mask, 0, i), mask=mask))
    no = np.zeros(len(at), dtype=bool)
    return c.table(at, node=at, parent=up, k=c.kids[at], snode=take(species, snode[at], no), event=take(events, event[at], no), ps=take(species, snode[top], none), pe=take(events, event[top], none))


def relations(event_name: str, skip) -> Callable[[Clump], pa.Table]:
    def f(c: Clump) -> pa.Table:
        snode, species, events, event = _recon(c)
        on = _is(events, event, event_name)
        if skip is not None:
            at = species.index(pa.scalar(skip, species.type)).as_py()
            on &= (snode != at) | (at < 0)
        gene = _is(events, event, "gene")
        a, b, top = c.pairs(np.flatnonzero(gene))
        # a pair of two sides: neither is the node itself
        keep = on[top] & (a != top) & (b != top)
        a, b, top = a[keep], b[keep], top[keep]
        low, at = c.closure(np.flatnonzero(gene))
        n_species = max(1, len(species))
        keys, counts = np.unique(at * n_species + snode[low], return_counts=True)
        n = []
        for x in (a, b):
            side = x.copy()
            while (go := c.up[side] != top).any():
                side = np.where(go, c.up[side], side)
            n.append(counts[np.searchsorted(keys, side * n_species + snode[x])] if len(side) else side)
        return c.table(a, node=top, a=a, b=b, n_a=n[0], n_b=n[1])

    return f


def consistency(c: Clump) -> pa.Table:
    snode, species, events, event = _recon(c)
    dup = _is(events, event, "dup")
    low, at = c.closure(np.flatnonzero(_is(events, event, "gene")))
    n_species = max(1, len(species))
    side = np.unique(at * n_species + snode[low])
    up, s = c.up[side // n_species], side % n_species
    on = (up >= 0) & dup[up]
    seen, sides = np.unique(up[on] * n_species + s[on], return_counts=True)
    node = seen // n_species
    whole, many = np.bincount(node, minlength=c.n), np.bincount(node, weights=sides > 1, minlength=c.n)
    at_ = np.flatnonzero(whole)
    return c.table(at_, node=at_, consistency=many[at_] / whole[at_])


def lineages(c: Clump) -> pa.Table:
    """(snode, tips, met): leaves and meetings (children but one) of the nodes of each species that a tree has."""
    snode, species, _, event = _recon(c)
    at = np.flatnonzero(event >= 0)
    n_species = max(1, len(species))
    key, row = np.unique(c.of[at] * n_species + snode[at], return_inverse=True)
    tips, met = (np.bincount(row, weights=w, minlength=len(key)).astype(np.int64) for w in (c.kids[at] == 0, np.maximum(c.kids[at] - 1, 0)))
    return pa.table({"tree_id": c.trees.take(pa.array(key // n_species)), "snode": species.take(pa.array(key % n_species)), "tips": tips, "met": met})


def clades(c: Clump) -> pa.Table:
    """The marked leaves below each node, in order."""
    low, at = c.closure(np.unique(c.at))
    order = np.lexsort((low, at))
    sizes = np.bincount(at, minlength=c.n)
    has = np.flatnonzero(sizes)
    return c.table(has, node=has, below=c.lists(low[order], sizes[has]))


def species_roots(top: int | None = None) -> Callable[[Clump], pa.Table]:
    """The marked nodes that have no marked one below them; in reconciled trees those of the species `top` are."""

    def f(c: Clump) -> pa.Table:
        return _lowest(c, c.at if top is None else c.at[_there(c, top)])

    return f


def _there(c: Clump, snode: int) -> np.ndarray:
    return pc.equal(c.beside["snode"], snode).to_numpy()


def _lowest(c: Clump, marked: np.ndarray) -> pa.Table:
    mine = np.zeros(c.n, dtype=bool)
    mine[marked] = True
    over = np.zeros(c.n, dtype=bool)
    for depth, (_, at) in enumerate(c.steps(np.flatnonzero(mine))):
        if depth:
            over[at] = True
    at = np.flatnonzero(mine & ~over)
    return c.table(at, node=at)


def split_early(top: int | None = None) -> Callable[[Clump], pa.Table]:
    """Every node's highest ancestor that isn't marked; in reconciled trees duplications of the species `top` are."""

    def f(c: Clump) -> pa.Table:
        return _highest(c, c.at if top is None else c.at[_there(c, top) & pc.equal(c.beside["event"], "dup").to_numpy()])

    return f


def _highest(c: Clump, marked: np.ndarray) -> pa.Table:
    cut = np.zeros(c.n, dtype=bool)
    cut[marked] = True
    part = np.full(c.n, -1)
    for low, at in c.steps():
        part[low[~cut[at]]] = at[~cut[at]]
    at = np.flatnonzero(part >= 0)
    return c.table(at, part=part[at], node=at, parent=np.where(part[at] == at, -1, c.up[at]))


def _ancestors(c: Clump) -> tuple[np.ndarray, np.ndarray, pa.StructArray | None]:
    """The places of nodes above a known species, and that of the common ancestor among the flat routes.

    Rows beside are leaves with `pre`, the species's number, and `route`: the heads of the heavy paths on the way from the root down, each
    with the lowest level the way has on it. Common ancestors are where two routes part.
    """
    b = c.beside
    pre = b["pre"].to_numpy()
    order = np.argsort(pre, kind="stable")
    route = b["route"].combine_chunks() if b.num_rows else None
    low, high = np.full(c.n, -1), np.full(c.n, -1)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    big = len(order)
    low[:] = big
    held = np.arange(len(order))
    known = c.leaf[c.at]
    at, who = c.at[known], held[known]
    for _ in range(c.n + 1):
        if not len(at):
            break
        np.minimum.at(low, at, rank[who])
        np.maximum.at(high, at, rank[who])
        up = c.up[at]
        at, who = up[up >= 0], who[up >= 0]
    has = np.flatnonzero(high >= 0)
    if not len(has):
        return has, np.zeros(0, dtype=np.int64), None
    route = route.chunk(0) if isinstance(route, pa.ChunkedArray) else route
    offsets, flat = route.offsets.to_numpy(), route.values
    heads, levels = flat.field("head").to_numpy(), flat.field("level").to_numpy()
    x, y = order[low[has]], order[high[has]]
    x0, y0 = offsets[x], offsets[y]
    nx, ny = offsets[x + 1] - x0, offsets[y + 1] - y0
    # species of two trees have no common ancestor
    one = heads[x0] == heads[y0]
    has, x0, y0, nx, ny = has[one], x0[one], y0[one], nx[one], ny[one]
    met = np.where(levels[x0] <= levels[y0], x0, y0).astype(np.int64)
    open_ = np.flatnonzero(levels[x0] == levels[y0])
    step = 1
    while len(open_):
        open_ = open_[(nx[open_] > step) & (ny[open_] > step)]
        i, j = x0[open_] + step, y0[open_] + step
        same = heads[i] == heads[j]
        open_, i, j = open_[same], i[same], j[same]
        met[open_] = np.where(levels[i] <= levels[j], i, j)
        open_ = open_[levels[i] == levels[j]]
        step += 1
    return has, met, flat


#: Events by their numbers.
EVENTS = pa.array(["gene", "dup", "spec"])


def _located(c: Clump) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places of nodes above a known species, the head and level of the common ancestor on its heavy path, and the events' numbers."""
    has, met, flat = _ancestors(c)
    head, level = (np.zeros(0, dtype=np.int64) if flat is None else flat.field(x).to_numpy()[met].astype(np.int64) for x in ("head", "level"))
    return has, head, level, _events(c, has, head, level)


def _events(c: Clump, has: np.ndarray, head: np.ndarray, level: np.ndarray) -> np.ndarray:
    h, lv = np.full(c.n, -1), np.full(c.n, -1)
    h[has], lv[has] = head, level
    up = c.up[has]
    child = has[(up >= 0)]
    up = c.up[child]
    parent, same = np.zeros(c.n, dtype=bool), np.zeros(c.n, dtype=bool)
    parent[up] = True
    same[up[(h[child] == h[up]) & (lv[child] == lv[up])]] = True
    return np.where(~parent, 0, np.where(same, 1, 2))[has]


def reconcile(c: Clump) -> pa.Table:
    """(node, head, level, event): the common ancestor of the species below, as its place on a heavy path."""
    has, head, level, event = _located(c)
    return c.table(has, node=has, head=head, level=level, event=EVENTS.take(pa.array(event)))


def reconciled(c: Clump) -> pa.Table:
    """The trees packed again, with `snode`, the common ancestor's number (head and level in one), and `event` of every node."""
    has, head, level, event = _located(c)
    event = EVENTS.take(pa.array(event))
    row = np.full(c.n, -1)
    row[has] = np.arange(len(has))
    at = pa.array(np.maximum(row, 0), mask=row < 0)
    place = np.arange(c.n)
    snode = pa.array((head << 32) + level, pa.int64()).take(at)
    own = pa.StructArray.from_arrays([c.named(place), c.named(c.up), pa.array(c.dist), snode, event.take(at)], ["node", "parent", "dist", "snode", "event"])
    ends = np.concatenate(([0], np.cumsum(np.bincount(c.of, minlength=len(c.trees))))).astype(np.int32)
    return pa.table({"tree_id": c.trees, "own": pa.ListArray.from_arrays(pa.array(ends), own)})


def accuracy(batch: pa.RecordBatch) -> pa.Table:
    """What trees.accuracy_of_both() counts of `own`, the actual, and `other`, the predicted tree of a row, whose `tips` are beside both."""
    n = batch.num_rows
    pair = [Clump(pa.RecordBatch.from_arrays([batch.column(x) for x in ("tree_id", side, "tips")], ["tree_id", "own", "beside"])) for side in ("own", "other")]
    marked = [np.unique(c.at[c.leaf[c.at]]) for c in pair]
    ranks, whole = _ranks(pair, marked)
    raw = [_sets(c, rank, whole) for c, rank in zip(pair, ranks, strict=True)]
    known, number = np.unique(np.concatenate([x for x, _ in raw]), return_inverse=True)
    a, b = (_things(c, rank, whole, sets, size) for c, rank, sets, (_, size) in zip(pair, ranks, np.split(number, [pair[0].n]), raw, strict=True))
    tips = [np.flatnonzero(c.leaf) for c in pair]
    genes = [np.bincount(c.of[t], minlength=n) for c, t in zip(pair, tips, strict=True)]
    there = np.bincount(pair[1].of[tips[1]], weights=_places_in(*pair, tips[1], pair[0].leaf) >= 0, minlength=n)
    out = {"tree_id": batch.column("tree_id"), "ngenes": genes[1], "nbranches": np.bincount(pair[1].of, minlength=n) - genes[1] - 1, "was": genes[0], "alike": (genes[0] == genes[1]) & (there == genes[1])}
    # a duplication is a set cut into so many parts, of which a tree has one at most; two are the same if all their parts are
    keys = np.unique(np.concatenate((a["dup"][1], b["dup"][1])))
    parts = [np.unique(np.searchsorted(keys, x["parts"][0]) * len(known) + x["parts"][1]) for x in (a, b)]
    alike = np.bincount(np.intersect1d(*parts, assume_unique=True) // max(1, len(known)), minlength=len(keys))
    for name in ("dup", "loss", "orth"):
        (tree, key, many), (tree_b, key_b, many_b) = a[name], b[name]
        _, i, j = np.intersect1d(key, key_b, assume_unique=True, return_indices=True)
        if name == "dup":
            i = i[alike[np.searchsorted(keys, key[i])] == many[i]]
        # losses above a set begin at the same species, so the fewer ones are the first of the others
        each = (many, many_b, np.minimum(many[i], many_b[j])) if name == "loss" else (None, None, None)
        for what, t, w in zip(("actual", "pred", "both"), (tree, tree_b, tree[i]), each, strict=True):
            out[f"{name}_{what}"] = np.bincount(t, weights=w, minlength=n).astype(np.int64)
    for name, c in zip("xy", pair, strict=True):
        at, side, other = _splits(c, False)
        out[name] = pa.ListArray.from_arrays(_ends(c.of[at], n), pa.StructArray.from_arrays([side, other], ["side", "other"]))
    return pa.table(out)


def _places_in(a: Clump, b: Clump, at: np.ndarray, on: np.ndarray) -> np.ndarray:
    """The places in a of b's nodes `at` of the same tree and name, -1 where a has none that is `on`."""
    code = pc.fill_null(pc.index_in(b.names, value_set=a.names), -1).to_numpy().astype(np.int64)
    mine = code[b.code[at]] if len(at) else at
    got = a.place(np.where(mine < 0, -1, b.of[at] * a.width + mine))
    return np.where((got >= 0) & (on[np.maximum(got, 0)] if a.n else False), got, -1)


def _ranks(pair: list[Clump], marked: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Numbers of the marked leaves, the same in both clumps, -1 at other nodes, and how many there are; those below a node of the first follow each other."""
    a, b = pair
    below = np.zeros(a.n, dtype=np.int64)
    for _, at in a.steps(marked[0]):
        np.add.at(below, at, 1)
    # leaves below earlier children of the same parent, summed up the tree; whole trees come one after the other
    order = np.lexsort((np.arange(a.n), a.up, a.of))
    before = np.cumsum(below[order]) - below[order]
    head = np.ones(a.n, dtype=bool)
    head[1:] = (a.up[order][1:] != a.up[order][:-1]) | (a.of[order][1:] != a.of[order][:-1])
    earlier = np.zeros(a.n, dtype=np.int64)
    earlier[order] = before - before[head][np.cumsum(head) - 1] if a.n else before
    first = np.zeros(a.n, dtype=np.int64)
    for low, at in a.steps():
        first[low] += earlier[at]
    other = _places_in(a, b, marked[1], np.isin(np.arange(a.n), marked[0]))
    extra = marked[1][other < 0]
    many = [np.bincount(c.of[m], minlength=len(a.trees)) for c, m in ((a, marked[0]), (b, extra))]
    base = np.cumsum(many[0] + many[1]) - many[0] - many[1]
    rank = [np.full(c.n, -1) for c in pair]
    rank[0][marked[0]] = base[a.of[marked[0]]] + first[marked[0]]
    rank[1][marked[1][other >= 0]] = rank[0][other[other >= 0]]
    rank[1][extra] = base[b.of[extra]] + many[0][b.of[extra]] + np.arange(len(extra)) - (np.cumsum(many[1]) - many[1])[b.of[extra]]
    return rank, int(many[0].sum() + many[1].sum())


def _sets(c: Clump, rank: np.ndarray, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for the set of marked leaves below each node, and the size of that.

    A set is told by its least rank, its size, and whether its ranks follow each other: sets below nodes of
    a tree that share a leaf and a size are the same, and all those of the first clump follow each other.
    """
    size, low, high = np.zeros(c.n, dtype=np.int64), np.full(c.n, whole), np.full(c.n, -1)
    for leaf, at in c.steps(np.flatnonzero(rank >= 0)):
        np.add.at(size, at, 1)
        np.minimum.at(low, at, rank[leaf])
        np.maximum.at(high, at, rank[leaf])
    return (low + np.where(high - low + 1 == size, 0, whole + 1)) * (whole + 1) + size, size


def _things(c: Clump, rank: np.ndarray, whole: int, sets: np.ndarray, size: np.ndarray) -> dict:
    """(tree, key, number) of the duplications and their numbers of parts, the sets with losses above them, and the orthologs of a clump, each once; `parts` are (duplication, set)."""
    has, met, flat = _ancestors(c)
    none = np.zeros(0, dtype=np.int64)
    if flat is None:
        return dict.fromkeys(("dup", "loss", "orth"), (none, none, none)) | {"parts": (none, none)}
    passed, last = (pc.fill_null(flat.field(x), 0).to_numpy(zero_copy_only=False)[met].astype(np.int64) for x in ("passed", "last"))
    head, level = (flat.field(x).to_numpy()[met].astype(np.int64) for x in ("head", "level"))
    event, row = np.full(c.n, -1), np.full(c.n, -1)
    event[has], row[has] = _events(c, has, head, level), np.arange(len(has))
    child = np.flatnonzero((c.up >= 0) & (size > 0))
    child = child[event[c.up[child]] == 1]
    sides = np.bincount(c.up[child], minlength=c.n)
    key = sets * (MOST + 1) + sides
    dups, once = np.unique(key[np.flatnonzero(sides)], return_index=True)
    dup = np.flatnonzero(sides)[once]
    below = has[c.up[has] >= 0]
    below = below[row[c.up[below]] >= 0]
    top = row[c.up[below]]
    lost = passed[row[below]] - passed[top] - np.where(event[c.up[below]] == 1, 0, last[top])
    below, lost = below[lost > 0], lost[lost > 0]
    above, at = np.unique(sets[below], return_inverse=True)
    most, of = np.zeros(len(above), dtype=np.int64), np.zeros(len(above), dtype=np.int64)
    # of nodes with the same leaves only the top one's branch leaves their species
    np.maximum.at(most, at, lost)
    of[at] = c.of[below]
    a, b, node = c.pairs(np.flatnonzero(rank >= 0))
    on = event[node] == 2
    a, b = a[on], b[on]
    pair = np.minimum(rank[a], rank[b]) * whole + np.maximum(rank[a], rank[b])
    return {"dup": (c.of[dup], dups, sides[dup]), "loss": (of, above, most), "orth": (c.of[a], pair, none), "parts": (key[c.up[child]], sets[child])}
