import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph, rearrange, trees
from millrace.sources import text

SP = "((a,b)ab,(c,d)cd)all;"


def tree(s):
    return trees.Tree([(n, p, d) for n, p, _, d, _ in text.parse_newick(s)])


def forest(spark, *newicks):
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(newicks)], "tree_id string, newick string")
    return text.newick_nodes(df).select("tree_id", "node", "parent", "dist")


def random_tree(rng, names):
    rows, live = {}, list(names)
    for i in range(len(names) - 1):
        a, b = rng.sample(live, 2)
        rows[a] = rows[b] = f"i{i}"
        live = [x for x in live if x not in (a, b)] + [f"i{i}"]
    rows[live[0]] = None
    return trees.Tree([(n, p, 1.0) for n, p in rows.items()])


def counted(t, species, tips):
    """Duplications and losses by following every branch of a rooted tree."""
    up = species.parent

    def line(s):
        return [s] + (line(up[s]) if up[s] is not None else [])

    at = t.fold(lambda n, got: tips[n] if not got else next(s for s in line(got[0]) if all(s in line(g) for g in got)))
    dups = lost = 0
    for n in t.preorder():
        dup = any(at[k] == at[n] for k in t.kids[n])
        dups += len(t.kids[n]) - 1 if dup else 0
        for k in t.kids[n]:
            way = line(at[k])
            way = way[1 : way.index(at[n]) + (1 if dup else 0)]
            lost += sum(len(species.kids[s]) - 1 for s in way)
    return dups, lost


def test_root_costs_against_every_root():
    rng, species = random.Random(4), tree(SP)
    for _ in range(30):
        names = [f"{rng.choice('abcd')}{i}" for i in range(rng.randrange(3, 9))]
        t, tips = random_tree(rng, names), {n: n[0] for n in names}
        costs = rearrange.root_costs(t, species, tips)
        assert len(costs) == 2 * len(names) - 3
        for n, cost in costs.items():
            assert counted(trees.reroot(t, n), species, tips) == cost
        best = rearrange.root_by_events(t, species, tips)
        assert sum(counted(best, species, tips)) == min(map(sum, costs.values()))
        # any old root leads to the same
        again = rearrange.root_by_events(trees.reroot(t, rng.choice(sorted(costs))), species, tips)
        assert trees.topology(again) == trees.topology(best)


def test_root_edge_cases():
    species = tree(SP)
    two = tree("(a1,b1)r;")
    assert rearrange.root_by_events(two, species, {"a1": "a", "b1": "b"}) is two
    single = tree("((a1,b1,c1)x)r;")
    assert trees.topology(rearrange.root_by_events(single, species, {n: n[0] for n in ("a1", "b1", "c1")})) == "((a1,b1),c1)"
    star = tree("(a1,b1,c1)r;")
    assert rearrange.root_costs(star, species, {n: n[0] for n in ("a1", "b1", "c1")}).keys() == {"a1", "b1", "c1"}


def test_rooted_forest(spark):
    sp = spark.createDataFrame([(n, p) for n, p, _ in tree(SP).rows()], "node string, parent string")
    n = forest(spark, "(a1,(b1,(c1,d1)x)y)r;", "(a1,b1)r;")
    tips = trees.leaves(n).select("tree_id", "node", F.substring("node", 1, 1).alias("species"))
    got = {r[0]: r[1] for r in trees.each_string(rearrange.rooted_forest(n, sp, tips), trees.topology, "s").collect()}
    assert got == {"0": "((a1,b1),(c1,d1))", "1": "(a1,b1)"}
    with pytest.raises(ValueError, match="more than 3 nodes"):
        trees.small_tree(sp, 3)


def test_moves():
    t = tree("((a:1,b:1)x:1,(c:1,d:1)y:1)r;")
    assert len(rearrange.nni_moves(t)) == 4
    unrooted = {trees.topology(trees.reroot(rearrange.swapped(t, *m), "a")) for m in rearrange.nni_moves(t, rooted=False)}
    assert unrooted == {trees.topology(tree(s)) for s in ("(a,(c,(b,d)));", "(a,(d,(b,c)));")}
    whole = sum(d for _, _, d in t.rows())
    near = {trees.topology(t)}
    for m in rearrange.spr_moves(t):
        got = rearrange.regrafted(t, *m)
        assert sorted(got.leaves()) == list("abcd") and all(len(k) in (0, 2) for k in got.kids.values())
        assert sum(d for _, _, d in got.rows()) <= whole + 1e-9
        near.add(trees.topology(got))
    assert len(near) > 10


def test_search_finds_a_tree():
    want = {frozenset("ab"), frozenset("abc"), frozenset("abcd")}

    def score(t):
        return len(want & set(t.fold(lambda n, got: frozenset().union(*got) if got else frozenset(n)).values()))

    start = tree("((e,a),((d,b),c));")
    got, top = rearrange.search(start, score, 400, 3)
    assert top == 3 and trees.topology(got) == "((((a,b),c),d),e)"
    assert rearrange.search(start, score, 200, 3, prescreen=score, batch=4)[1] == 3
    assert rearrange.search(start, score, 20, 5)[1] == rearrange.search(start, score, 20, 5)[1]


def test_reconciliations():
    t = tree(SP)
    tips = {n: n for n in t.leaves()}
    all_ = list(rearrange.reconciliations(t, t, tips))
    assert len(all_) == 18 == len({tuple(sorted(r.items())) for r in all_})
    assert all_[0] == {"all": ("all", "spec"), "ab": ("ab", "spec"), "cd": ("cd", "spec"), **{x: (x, "gene") for x in "abcd"}}
    assert len(list(rearrange.reconciliations(t, t, tips, 0))) == 1
    assert len(list(rearrange.reconciliations(t, t, tips, 1))) == 4


@pytest.fixture(scope="module")
def genes(spark):
    n = graph.cut(forest(spark, "((a1,c1)x,(b1,b2)y)r;", "((a1,b1)x,c1)r;", "(a1,d1)r;"))
    tips = trees.leaves(n).select("tree_id", "node", F.substring("node", 1, 1).alias("species"))
    sp = spark.createDataFrame([(k, p) for k, p, _ in tree(SP).rows()], "node string, parent string")
    return n, sp, graph.cut(trees.reconcile(n, sp, tips))


def test_branch_events(genes):
    got = {}
    for r in sorted(rearrange.branch_events(*genes).collect()):
        got.setdefault((r.tree_id, r.node), []).append((r.snode, r.event))
    assert got["0", "y"] == [("all", "specloss"), ("ab", "specloss"), ("b", "dup")]
    assert got["0", "b1"] == [("b", "gene")] and got["0", "r"] == [("all", "dup")]
    assert got["2", "a1"] == [("ab", "specloss"), ("a", "gene")]


def test_species_roots_and_parts(genes):
    assert sorted(map(tuple, rearrange.species_roots(*genes).collect())) == [("0", "x"), ("1", "r"), ("2", "r")]
    got = sorted((r.tree_id, r.part, r.node, r.parent or "") for r in rearrange.split_early(*genes).collect() if r.tree_id == "0")
    assert got == [("0", "x", "a1", "x"), ("0", "x", "c1", "x"), ("0", "x", "x", ""), ("0", "y", "b1", "y"), ("0", "y", "b2", "y"), ("0", "y", "y", "")]


def test_lineages(genes):
    got = {(r.tree_id, r.snode): (r.low, r.high) for r in rearrange.lineages(*genes).collect()}
    assert got["0", "b"] == (2, 1) and got["0", "ab"] == (2, 2) and got["0", "all"] == (3, 1)
    assert got["1", "ab"] == (2, 1) and got["1", "all"] == (2, 1)


def test_multispecies_probabilities_sum_to_one(spark):
    """Three genes of three species: all topologies and places of the first meeting."""
    sp = spark.createDataFrame([("r", None, 0.0), ("ab", "r", 1.5), ("a", "ab", 1.0), ("b", "ab", 1.0), ("c", "r", 2.5)], "node string, parent string, dist double")
    n = forest(spark, "((a1,b1)x,c1)t;", "((a1,b1)x,c1)t;", "((a1,c1)x,b1)t;", "((b1,c1)x,a1)t;")
    at = [("0", "ab")] + [(str(i), "r") for i in (1, 2, 3)]
    leaf = [(str(i), f"{s}1", s, "gene") for i in range(4) for s in "abc"]
    recon = spark.createDataFrame(leaf + [(i, "x", s, "spec") for i, s in at] + [(i, "t", "r", "spec") for i, _ in at], "tree_id string, node string, snode string, event string")
    got = {r.tree_id: math.exp(r.log_p) for r in rearrange.multispecies_log_prob(n, sp, recon, F.lit(2.0)).collect()}
    apart = math.exp(-1.5 / 2)
    assert got == pytest.approx({"0": 1 - apart, "1": apart / 3, "2": apart / 3, "3": apart / 3})


def test_roots_are_found_without_the_species_tree(spark, monkeypatch):
    """A species tree of any size: tasks tell common ancestors and losses from the routes of a tree's own species."""
    monkeypatch.setattr(trees, "small_tree", None)
    monkeypatch.setattr(rearrange, "KEPT", 2)
    rng, rows, tips, want = random.Random(9), [], [], {}
    sp = [("s0", None, 0.0)] + [(f"s{i}", f"s{rng.randrange(max(0, i - 9), i)}", 0.0) for i in range(1, 40)]
    for t in range(40):
        names = [f"n{i}" for i in range(rng.randint(2, 14))]
        mine = [(n, names[rng.randrange(i)] if i else None, float(rng.randint(1, 9))) for i, n in enumerate(names)]
        got = trees.Tree(sorted(mine))
        of = {n: f"s{rng.randrange(40)}" for n in got.leaves()}
        rows += [(f"t{t}", *r) for r in mine]
        tips += [(f"t{t}", *x) for x in of.items()]
        want |= {(f"t{t}", n): (p, d) for n, p, d in rearrange.root_by_events(got, trees.Tree(sp), of, 2, 1).rows()}
    nodes = spark.createDataFrame(rows, "tree_id string, node string, parent string, dist double")
    species = spark.createDataFrame([r[:2] for r in sp], "node string, parent string")
    got = rearrange.rooted_forest(nodes, species, spark.createDataFrame(tips, "tree_id string, node string, species string"), 2, 1)
    assert {(r.tree_id, r.node): (r.parent, r.dist) for r in got.collect()} == want
