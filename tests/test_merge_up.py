"""Families merged up a tree against the same rule applied node by node."""

import random

import pytest

from millrace.operators import genes
from millrace.plans import driver
from millrace.plans import genes as plans


def plain(species, of, hits):
    """{gene: family}, nodes from the leaves to the root, one pair of families after another."""
    kids = {}
    for n, p in species:
        kids.setdefault(p, []).append(n)
    both = [(a, b, s) for x, y, s in hits if x != y and s is not None and x in of and y in of for a, b in ((x, y), (y, x))]
    family = {}

    def merge(node):
        below = {g for g, s in of.items() if s == node}
        for g in below:
            family[g] = g
        sides = [(k, merge(k)) for k in kids.get(node, [])]
        side = {g: k for k, gs in sides for g in gs}
        below |= set(side)
        near, far = {}, {}
        for a, b, s in both:
            if a not in side:
                continue
            if b not in below:
                far.setdefault(family[a], []).append(s)
            elif b in side and side[a] != side[b]:
                near.setdefault(family[a], {}).setdefault(family[b], []).append(s)
        mean = lambda v: sum(v) / len(v) if v else 0.0
        pairs = []
        for f, others in near.items():
            ways = [(-mean(v), o) for o, v in others.items() if mean(v) > max(mean(far.get(f)), mean(far.get(o)))]
            if ways:
                pairs.append((f, min(ways)[1]))
        name = {f: f for f in {family[g] for g in side}}
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                low = min(name[a], name[b])
                for x in (a, b):
                    if name[x] != low:
                        name[x], changed = low, True
        for g in side:
            family[g] = name[family[g]]
        return below

    for root in kids.get(None, []):
        merge(root)
    return family


@pytest.mark.parametrize("seed", [1, 2])
def test_against_one_node_after_another(spark, seed):
    """Uneven heights, several children, one gene with most hits, unknown genes, null scores and hits of a gene with itself."""
    rng = random.Random(seed)
    species = [("root", None), ("x", "root"), ("y", "root"), ("e", "root"), ("a", "x"), ("b", "x"), ("z", "y"), ("c", "y"), ("d1", "z"), ("d2", "z"), ("d3", "z")]
    of = {f"g{i:02}": rng.choice(["a", "b", "c", "d1", "d2", "d3", "e"]) for i in range(40)}
    names = [*of, "nobody"]
    hits = [(a, b, rng.choice([None, *range(1, 9)])) for a, b in (rng.sample(names, 2) for _ in range(60))] + [("g00", rng.choice(names), rng.randrange(1, 9)) for _ in range(60)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = genes.merge_up_tree(make(species, "node string, parent string"), make([*of.items(), ("lost", "nowhere"), ("none", None)], "gene string, species string"), make(hits, "gene1 string, gene2 string, score int"))
    assert {r.gene: r.family for r in got.collect()} == plain(species, of, hits)


def test_without_hits(spark):
    got = genes.merge_up_tree(spark.createDataFrame([("r", None), ("a", "r")], "node string, parent string"), spark.createDataFrame([("g", "a"), ("h", "a")], "gene string, species string"), spark.createDataFrame([], "gene1 string, gene2 string, score double"))
    assert sorted(map(tuple, got.collect())) == [("g", "g"), ("h", "h")]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    species, of, hits = (x.collect() for x in plans.trade(spark, d))
    want = plain([tuple(r) for r in species], {r.gene: r.species for r in of}, [(r.gene1, r.gene2, float(r.score)) for r in hits])
    assert {r.gene: r.family for r in driver.QUERIES["families_up_tree"](spark, d).collect()} == want
