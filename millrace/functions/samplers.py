"""Seeded samplers of trees and recombination graphs, and allele frequencies under drift.

Every row carries its seed, so a rerun of a lost task gives the same rows. A
row's tree or graph is drawn in one task and must fit there.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .special import lit

NODES = "tree_id string, node string, parent string, dist double"


def frequency_density(x: Column, p: Column, n, t, terms: int = 8) -> Column:
    """Density of an allele's frequency x between 0 and 1 after t generations of drift from p in n diploids.

    Kimura's series: the polynomials of x and p are Gegenbauer's of degree
    i - 1 and index 3/2, by their recurrence.
    """
    x, p, t = x.cast("double"), p.cast("double"), lit(t)
    z, y = 1 - 2 * x, 1 - 2 * p

    def after(now, before, i, at):
        return ((2 * i + 1) * at * now - (i + 1) * before) / i

    def step(s, i):
        term = (2 * i + 1) * 4.0 / (i * (i + 1)) * s["x1"] * s["p1"] * F.exp(-t * i * (i + 1) / (4.0 * lit(n)))
        grown = {"x1": after(s["x1"], s["x0"], i, z), "x0": s["x1"], "p1": after(s["p1"], s["p0"], i, y), "p0": s["p1"]}
        return F.struct(*(v.alias(k) for k, v in grown.items()), (s["sum"] + term).alias("sum"))

    zero = F.struct(*(F.lit(v).alias(k) for k, v in (("x1", 1.0), ("x0", 0.0), ("p1", 1.0), ("p0", 0.0), ("sum", 0.0))))
    return p * (1 - p) * F.aggregate(F.sequence(F.lit(1), F.lit(terms)), zero, step, lambda s: s["sum"])


def frequency_between(p: Column, low: Column, high: Column, n, t, terms: int = 50) -> Column:
    """The chance that a frequency lies between low and high, above 0 and below 1, after t generations of drift from p in n diploids.

    The integral of frequency_density(): Legendre polynomials of p and the
    bounds, by their recurrence.
    """
    y, t = 1 - 2 * p.cast("double"), lit(t)
    ends = {"l": 1 - 2 * low.cast("double"), "h": 1 - 2 * high.cast("double")}

    def after(now, before, i, at):
        return ((2 * i + 1) * at * now - i * before) / (i + 1)

    def step(s, i):
        up = after(s["p1"], s["p0"], i, y)
        term = 0.5 * (s["p0"] - up) * F.exp(-t * i * (i + 1) / (4.0 * lit(n))) * (s["l1"] - s["h1"])
        grown = {"p1": up, "p0": s["p1"]}
        for k, at in ends.items():
            grown |= {f"{k}1": after(s[f"{k}1"], s[f"{k}0"], i, at), f"{k}0": s[f"{k}1"]}
        return F.struct(*(v.alias(k) for k, v in grown.items()), (s["sum"] + term).alias("sum"))

    first = {"p1": y, "p0": F.lit(1.0), "l1": ends["l"], "l0": F.lit(1.0), "h1": ends["h"], "h0": F.lit(1.0), "sum": F.lit(0.0)}
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(*(v.alias(k) for k, v in first.items())), step, lambda s: s["sum"])


def sample_frequencies(rows: DataFrame, p: str, n: str, generations: int, seed: str, out: str) -> DataFrame:
    """Adds the frequency after so many generations of binomial drawing of 2 n gene copies."""

    def run(batches):
        import numpy as np

        for pdf in batches:
            got = []
            for p_, n_, s in zip(pdf[p], pdf[n], pdf[seed], strict=True):
                rng, k, copies = np.random.default_rng(int(s)), float(p_), 2 * int(n_)
                for _ in range(generations):
                    k = rng.binomial(copies, k) / copies
                    if k in (0.0, 1.0):
                        break
                got.append(k)
            pdf[out] = got
            yield pdf

    return rows.mapInPandas(run, rows.withColumn(out, F.lit(0.0)).schema)


# Coalescent times under a condition


def chance_of_counts(a: int, b: int, t: float, n: float) -> float:
    """The chance that a lineages have b ancestors after t: the rates are all different, so a sum of exponentials."""
    if not 1 <= b <= a or t < 0:
        return 0.0
    if a == b:
        return math.exp(-b * (b - 1) / 2 / n * t)
    total = 0.0
    for k in range(b, a + 1):
        size = math.lgamma(b + k - 1) - math.lgamma(b) + math.lgamma(a) + math.lgamma(a + 1) - math.lgamma(a - k + 1) - math.lgamma(a + k) - math.lgamma(b + 1) - math.lgamma(k - b + 1)
        total += (-1) ** (k - b) * (2 * k - 1) * math.exp(size - k * (k - 1) / 2 / n * t)
    return min(1.0, max(0.0, total))


def times_given(k: int, left: int, n: float, until: float, rng: random.Random) -> list[float]:
    """When k lineages meet, given that `left` of them remain at `until`.

    No meeting before x and the right number in the end has the chance
    exp(-rate x) g(until - x), g as chance_of_counts; each wait is its inverse
    at a uniform number, found by halving.
    """
    out, now = [], 0.0
    while k > left:
        rest, rate = until - now, k * (k - 1) / 2 / n
        want = rng.random() * chance_of_counts(k, left, rest, n)
        low, high = 0.0, rest
        for _ in range(60):
            x = (low + high) / 2
            if math.exp(-rate * x) * chance_of_counts(k, left, rest - x, n) > want:
                low = x
            else:
                high = x
        now, k = now + (low + high) / 2, k - 1
        out.append(now)
    return out


def sample_times_given(rows: DataFrame, k: str, n: str, until: str, seed: str, left: int = 1) -> DataFrame:
    """(seed, lineages, t) for every row of k > left: left = 1 is the coalescent bounded by `until`."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for kk, nn, u, s in zip(pdf["k"], pdf["n"], pdf["until"], pdf["seed"], strict=True):
                ts = times_given(int(kk), left, nn, u, random.Random(int(s)))
                out += [(int(s), int(kk) - i, t) for i, t in enumerate(ts)]
            yield pd.DataFrame(out, columns=["seed", "lineages", "t"])

    got = rows.select(F.col(k).cast("int").alias("k"), F.col(n).cast("double").alias("n"), F.col(until).cast("double").alias("until"), F.col(seed).cast("long").alias("seed"))
    return got.mapInPandas(run, "seed long, lineages int, t double")


# Birth and death


def birth_death_tree(until: float, birth: float, death: float, rng: random.Random, doomed: bool = False) -> list[tuple]:
    """(node, parent, dist) of a tree grown from one lineage; without `doomed` only what leads to living leaves, possibly none.

    Nodes of a single child are left out and their lengths added to it, but for the root.
    """
    kids: dict = {"n0": []}
    dist, alive, todo, free = {"n0": 0.0}, {}, [("n0", 0.0)], 1
    while todo:
        up, t = todo.pop()
        node, free = f"n{free}", free + 1
        wait = rng.expovariate(birth + death) if birth + death > 0 else until - t
        kids[up].append(node)
        kids[node], end = [], min(until, t + wait)
        dist[node] = end - t
        if end >= until:
            alive[node] = True
        elif rng.random() * (birth + death) < birth:
            todo += [(node, end), (node, end)]
        else:
            alive[node] = doomed
    order, at = [], ["n0"]
    while at:
        order.append(at.pop())
        at += kids[order[-1]]
    live: dict = {}
    for x in reversed(order):
        live[x] = alive.get(x, False) or any(live[c] for c in kids[x])
    rows, todo2 = [], [("n0", None, 0.0)] if live["n0"] else []
    while todo2:
        x, up, extra = todo2.pop()
        left = [c for c in kids[x] if live[c]]
        if up is not None and len(left) == 1:
            todo2.append((left[0], up, extra + dist[x]))
            continue
        rows.append((x, up, extra + dist[x]))
        todo2 += [(c, x, 0.0) for c in left]
    return rows


def sample_birth_death_trees(rows: DataFrame, until: str, birth: float, death: float, seed: str, doomed: bool = False) -> DataFrame:
    """A tree for every row as (tree_id, node, parent, dist), tree_id being the seed; rows that die out have none."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(str(s), *r) for s, u in zip(pdf["seed"], pdf["until"], strict=True) for r in birth_death_tree(u, birth, death, random.Random(int(s)), doomed)], columns=["tree_id", "node", "parent", "dist"])

    return rows.select(F.col(until).cast("double").alias("until"), F.col(seed).cast("long").alias("seed")).mapInPandas(run, NODES)


def gene_tree(species, birth: float, death: float, rng: random.Random):
    """A Tree of genes grown down a species Tree, duplicated and lost on its branches; None if no gene lives.

    A gene is named by its species and a number. Nodes of one child are left out.
    """
    from ..operators.trees import Tree, keep_leaves

    rows: list[tuple] = []
    genes, free = set(), iter(range(1 << 62))

    def name(s):
        return f"{s}_{next(free)}"

    todo = [(species.root, None)]  # the species branch that a gene enters, and the node above it
    while todo:
        s, up = todo.pop()
        grown = birth_death_tree(species.dist[s], birth, death, rng)
        to = {n: name(s) for n, _, _ in grown}
        inner = {p for _, p, _ in grown}
        for n, p, d in grown:
            rows.append((to[n], up if p is None else to[p], d))
            if n in inner:
                continue
            if species.kids[s]:
                todo += [(k, to[n]) for k in species.kids[s]]
            else:
                genes.add(to[n])
    return keep_leaves(Tree(rows), genes) if genes else None


def sample_gene_trees(rows: DataFrame, species: DataFrame, birth: float, death: float, seed: str) -> DataFrame:
    """A gene tree for every row as (tree_id, node, parent, dist), tree_id being the seed. The species tree (node, parent, dist) goes to the tasks, up to the bound of small_tree()."""
    import pandas as pd

    from ..operators.trees import Tree, small_tree

    nodes = small_tree(species)

    def run(batches):
        for pdf in batches:
            out = []
            for s in pdf["seed"]:
                got = gene_tree(Tree(nodes), birth, death, random.Random(int(s)))
                out += [(str(s), *r) for r in got.rows()] if got else []
            yield pd.DataFrame(out, columns=["tree_id", "node", "parent", "dist"])

    return rows.select(F.col(seed).cast("long").alias("seed")).mapInPandas(run, NODES)


# Recombination graphs


def recombination_graph(k: int, n: float, rho: float, start: float, end: float, rng: random.Random) -> list[tuple]:
    """(name, event, age, pos, parents) of a random graph of k samples over start to end.

    Looking back, two lineages meet at rate pairs / n, and one recombines at
    rate rho times the span of what it carries, gaps included. Material that
    has met all samples' is not followed further.
    """
    live: dict = {f"s{i}": [(start, end, 1)] for i in range(k)}
    out = {x: [x, "gene", 0.0, 0.0, []] for x in live}
    t, free = 0.0, 0
    while len(live) > 1:
        names = list(live)
        spans = [live[x][-1][1] - live[x][0][0] for x in names]
        meet, cut = len(names) * (len(names) - 1) / 2 / n, rho * sum(spans)
        t += rng.expovariate(meet + cut)
        if rng.random() * (meet + cut) < meet:
            a, b = rng.sample(names, 2)
            name, free = f"c{free}", free + 1
            out[name] = [name, "coal", t, 0.0, []]
            out[a][4].append(name)
            out[b][4].append(name)
            rest = [x for x in _overlaid(live.pop(a), live.pop(b)) if x[2] < k]
            if rest:
                live[name] = rest
        else:
            a = rng.choices(names, spans)[0]
            pos = rng.uniform(live[a][0][0], live[a][-1][1])
            name, free = f"r{free}", free + 1
            parts = live.pop(a)
            out[name] = [name, "recomb", t, pos, []]
            out[a][4].append(name)
            for side, keep in (("l", [(x, min(y, pos), m) for x, y, m in parts if x < pos]), ("r", [(max(x, pos), y, m) for x, y, m in parts if y > pos])):
                # each side goes on as a lineage of its own, hung to the node in order of the sides
                live[name + side] = keep
                out[name + side] = [name + side, "side", t, 0.0, []]
                out[name][4].append(name + side)
    return _without_sides(out)


def _without_sides(out: dict) -> list[tuple]:
    def real(x):
        while x is not None and out[x][1] == "side":
            x = out[x][4][0] if out[x][4] else None
        return x

    return [(x, e, t, pos, [p for p in map(real, up) if p is not None]) for x, e, t, pos, up in out.values() if e != "side"]


def _overlaid(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """The pieces of two lists of (from, to, samples), the samples added where both are."""
    marks = sorted({x for p in (a, b) for f, t, _ in p for x in (f, t)})
    out, i, j = [], 0, 0
    for f, t in zip(marks, marks[1:], strict=False):
        while i < len(a) and a[i][1] <= f:
            i += 1
        while j < len(b) and b[j][1] <= f:
            j += 1
        m = (a[i][2] if i < len(a) and a[i][0] <= f else 0) + (b[j][2] if j < len(b) and b[j][0] <= f else 0)
        if m:
            out.append((f, t, m))
    return out


def sample_graphs(rows: DataFrame, k: str, n: str, rho: float, seed: str, start: float = 0.0, end: float = 1.0) -> DataFrame:
    """(graph, name, event, age, pos, parents) of a graph for every row; graph is the seed."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(int(s), *r) for kk, nn, s in zip(pdf["k"], pdf["n"], pdf["seed"], strict=True) for r in recombination_graph(int(kk), nn, rho, start, end, random.Random(int(s)))], columns=["graph", "name", "event", "age", "pos", "parents"])

    got = rows.select(F.col(k).cast("int").alias("k"), F.col(n).cast("double").alias("n"), F.col(seed).cast("long").alias("seed"))
    return got.mapInPandas(run, "graph long, name string, event string, age double, pos double, parents array<string>")


def sample_mutations(branches: DataFrame, rate: float, seed: int) -> DataFrame:
    """(child, parent, pos, age) of mutations on the branches (child, parent, lo, hi, young, old), at `rate` per length and time."""
    import pandas as pd

    def run(batches):
        import zlib

        import numpy as np

        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                rng = np.random.default_rng([seed, zlib.crc32(f"{r.child} {r.parent} {r.lo!r}".encode())])
                for _ in range(rng.poisson(rate * (r.hi - r.lo) * (r.old - r.young))):
                    out.append((r.child, r.parent, rng.uniform(r.lo, r.hi), rng.uniform(r.young, r.old)))
            yield pd.DataFrame(out, columns=["child", "parent", "pos", "age"])

    cols = ["child", "parent", *(F.col(c).cast("double").alias(c) for c in ("lo", "hi", "young", "old"))]
    return branches.select(*cols).mapInPandas(run, "child string, parent string, pos double, age double")
