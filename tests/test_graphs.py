import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import samplers
from millrace.operators import arg, stats, synteny
from millrace.plans import driver
from millrace.sources import formats


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def small(spark):
    data = [("a", "gene", 0.0, 0.0, ["x"]), ("b", "gene", 0.0, 0.0, ["ab"]), ("c", "gene", 0.0, 0.0, ["ac"]), ("x", "recomb", 1.0, 4.0, ["ab", "ac"]), ("ab", "coal", 2.0, 0.0, ["r"]), ("ac", "coal", 3.0, 0.0, ["r"]), ("r", "coal", 5.0, 0.0, ["over"]), ("over", "coal", 9.0, 0.0, [])]
    return spark.createDataFrame(data, "name string, event string, age double, pos double, parents array<string>")


def test_edges_and_blocks(small):
    assert [x for x in rows(arg.edges(small, 0, 10), "child", "parent", "lo", "hi") if x[0] == "x"] == [("x", "ab", 0.0, 4.0), ("x", "ac", 4.0, 10.0)]
    assert rows(arg.blocks(small, 0, 10), "lo", "hi") == [(0.0, 4.0), (4.0, 10.0)]
    one = small.where("name = 'x'").withColumn("parents", F.slice("parents", 1, 1))
    assert rows(arg.edges(one, 0, 10), "parent", "lo", "hi") == [("ab", 0.0, 4.0)]


def test_local_trees(small):
    got = rows(arg.local_trees(small, arg.blocks(small, 0, 10), 0, 10), "tree_id", "node", F.coalesce("parent", F.lit("-")), F.coalesce("dist", F.lit(-1.0)))
    assert [x[1:3] for x in got if x[0] == 0] == [("a", "x"), ("ab", "r"), ("ac", "r"), ("b", "ab"), ("c", "ac"), ("r", "-"), ("x", "ab")]
    assert [x[1:3] for x in got if x[0] == 4] == [("a", "x"), ("ab", "r"), ("ac", "r"), ("b", "ab"), ("c", "ac"), ("r", "-"), ("x", "ac")]
    assert rows(arg.length(small, 0, 10), "lo", "branches") == [(0.0, 12.0), (4.0, 13.0)]


def test_lineages_and_splits(spark):
    e = spark.createDataFrame([(1, "coal"), (2, "recomb"), (3, "coal")], "t int, event string").withColumn("k", F.lit(0))
    assert rows(arg.lineages(e, ["k"], ["t"], "event", 3), "t", "lineages") == [(1, 2), (2, 3), (3, 2)]
    with pytest.raises(Exception, match="unknown event"):
        arg.lineages(e.withColumn("event", F.lit("?")), ["k"], ["t"], "event", 3).collect()
    aln = spark.createDataFrame([("q", "a", "ACA"), ("q", "b", "ACC"), ("q", "c", "GCT")], "aln_id string, name string, seq string")
    assert rows(arg.alignment_splits(aln), "pos", "side", "other") == [(0, ["c"], ["a", "b"])]
    m = spark.createDataFrame([(1.5, ["b", "a"])], "site double, carriers array<string>")
    leaves = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    assert rows(arg.site_splits(m, leaves), "side", "other") == [(["a", "b"], ["c"])]


def test_synteny_against_all_pairs(spark):
    rng = random.Random(2)
    data = [(i, rng.choice("AB"), s := rng.randrange(400), s + rng.randrange(9), "X", u := rng.randrange(200), u + rng.randrange(9), rng.choice((1, -1))) for i in range(120)]
    hits = spark.createDataFrame(data, "id int, chrom1 string, s1 int, e1 int, chrom2 string, s2 int, e2 int, strand int")

    def near(p, q, same):
        if p[0] >= q[0] or p[1] != q[1] or p[2] > q[3] + 10 or q[2] > p[3] + 10 or p[5] > q[6] + 15 or q[5] > p[6] + 15:
            return False
        order = (q[2] - p[2]) * (q[5] - p[5])
        return not same or p[7] == q[7] and order * p[7] >= 0

    for same in (False, True):
        want = sorted((p[0], q[0]) for p in data for q in data if near(p, q, same))
        assert want and rows(synteny.neighbours(hits, 10, 15, same), "a", "b") == want
    parts = synteny.clusters(hits, 10, 15)
    assert parts.count() == 120
    box = synteny.blocks(hits, parts)
    assert box.agg(F.sum("n")).first()[0] == 120


def test_collinear_against_a_scan(spark):
    rng = random.Random(9)
    data = []
    for i in range(400):
        near = i if rng.random() < 0.8 else i + rng.choice((-3, -1, 1, 4))
        data.append((i, "AB"[i // 250], i, "XY"[i // 180 % 2], near if i % 100 < 60 else -near, rng.choice((1, 1, 1, -1)) if i % 100 < 60 else rng.choice((-1, -1, 1))))
    at2 = {p[0]: (c, k) for c in "XY" for k, p in enumerate(sorted((p for p in data if p[3] == c), key=lambda p: (p[4], p[0])))}
    want, last, way = [], None, 0
    for p in data:
        step = 0
        if last and last[1] == p[1] and last[3] == p[3]:
            step = at2[p[0]][1] - at2[last[0]][1]
        if abs(step) == 1 and way == 0 or step != 0 and step == way and p[5] == way:
            want[-1].append(p[0])
            way = step
        else:
            want.append([p[0]])
            way = 0
        last = p
    got = {}
    for r in synteny.collinear(spark.createDataFrame(data, "id int, chrom1 string, pos1 int, chrom2 string, pos2 int, strand int")).collect():
        got.setdefault((r.chrom1, r.block), []).append((r.id, r.direction))
    assert sorted(sorted(i for i, _ in b) for b in got.values()) == sorted(want)
    assert any(len(b) > 5 and b[0][1] == 1 for b in got.values()) and any(len(b) > 5 and b[0][1] == -1 for b in got.values())


def test_q_values(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5), (5, 0.5)], "i int, p double")
    got = {r.i: r.q for r in stats.q_values(df, [], "p").collect()}
    assert got == pytest.approx({1: 0.05, 2: 0.2 / 3, 3: 0.2 / 3, 4: 0.5, 5: 0.5})


def brute_components(lines):
    items = {p: p for _, p in lines}
    by_order = {}
    for o, p in lines:
        by_order.setdefault(o, set()).add(p)
    while True:
        new = dict(items)
        for ps in by_order.values():
            low = min(new[p] for p in ps)
            new |= {p: low for p in ps}
        if new == items:
            return sorted(items.items())
        items = new


def test_components_over_all_lines(spark, tmp_path):
    rng = random.Random(3)
    lines = [(o, 40 * (o % 6) + rng.randrange(40)) for o in range(150) for _ in range(rng.randint(1, 3))] + [(900, 7), (901, 999)]
    spark.createDataFrame([(o, p, 1.0, 0.0) for o, p in lines], "l_orderkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = brute_components(lines)
    assert len({c for _, c in want}) > 6
    assert rows(driver.QUERIES["components_all"](spark, str(tmp_path)), "item", "component") == want
    data = "/root/testdata/sf0.001"
    lines = [tuple(r) for r in spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()]
    assert rows(driver.QUERIES["components_all"](spark, data), "item", "component") == brute_components(lines)


def test_rectangles_of_all_lines(spark, tmp_path):
    rng = random.Random(4)
    lines = [(rng.randrange(3), rng.randrange(40), float(rng.randint(1, 50)), rng.randint(1, 7), rng.randrange(11) / 100) for _ in range(300)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double, l_linenumber int, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    boxes = {}
    for k, i, x, y, _ in lines:
        a, b, c, e = boxes.get((k, i), (x, x, y, y))
        boxes[k, i] = min(a, x), max(b, x), min(c, y), max(e, y)
    want = [(k, i, j) for (k, i), (x1, x2, y1, y2) in boxes.items() for (k2, j), (u1, u2, v1, v2) in boxes.items() if k == k2 and i < j and x2 > u1 and x1 <= u2 and y2 > v1 and y1 <= v2]
    assert want and rows(driver.QUERIES["rectangle_overlap"](spark, str(tmp_path)), "k", "id", "id2") == sorted(want)


def clades(nodes):
    """{(leaves, age)} of {node: (parent, age)}, without nodes of one child."""
    kids: dict = {}
    for n, (p, _) in nodes.items():
        kids.setdefault(p, []).append(n)

    def under(n):
        return frozenset([n]) if n not in kids else frozenset().union(*map(under, kids[n]))

    return {(under(n), round(age, 9)) for n, (_, age) in nodes.items() if len(kids.get(n, [])) != 1}


@pytest.mark.parametrize("seed", [1, 4])
def test_rearrangements_lead_from_tree_to_tree(spark, seed):
    data = samplers.recombination_graph(6, 1.0, 1.2, 0.0, 1.0, random.Random(seed))
    g = spark.createDataFrame([tuple(r) for r in data], "name string, event string, age double, pos double, parents array<string>")
    ages = {r[0]: r[2] for r in data}
    parts = rows(arg.blocks(g, 0, 1), "lo", "hi")
    forest: dict = {}
    for r in arg.local_trees(g, arg.blocks(g, 0, 1), 0, 1).collect():
        forest.setdefault(r.tree_id, {})[r.node] = (r.parent, ages[r.node])
    moves = {r.pos: r for r in arg.rearrangements(g, 0, 1).collect()}
    left = {hi: forest[lo] for lo, hi in parts if hi < 1}
    assert len(moves) > 3 and set(moves) <= set(left)
    for pos, m in moves.items():
        assert len([n for n, (p, _) in left[pos].items() if p == m.rnode]) != 1
        assert ages[m.rnode] <= m.rtime <= m.ctime
    whole = []
    for pos, nodes in left.items():
        kids: dict = {}
        for n, (p, _) in nodes.items():
            kids.setdefault(p, []).append(n)
        for n, (p, age) in nodes.items():
            if len(kids.get(n, [])) == 1:
                continue
            while p is not None and len(kids[p]) == 1:
                p = nodes[p][0]
            whole.append((pos, n, p, age))
    trees_ = spark.createDataFrame(whole, "tree_id double, node string, parent string, age double")
    given = spark.createDataFrame([(m.pos, m.rnode, m.cnode, m.ctime, "new") for m in moves.values()], "tree_id double, rnode string, cnode string, ctime double, name string")
    after: dict = {}
    for r in arg.rearranged(trees_, given).collect():
        after.setdefault(r.tree_id, {})[r.node] = (r.parent, r.age)
    for pos, nodes in after.items():
        assert clades(nodes) == clades(forest[pos]), pos


def test_moves_beside_the_cut(spark):
    nodes = [(1, "r", None, 9.0), (1, "u", "r", 5.0), (1, "c", "r", 0.0), (1, "a", "u", 0.0), (1, "b", "u", 0.0)]

    def after(rnode, cnode, ctime):
        t = spark.createDataFrame([(1, *x[1:]) for x in nodes], "tree_id int, node string, parent string, age double")
        m = spark.createDataFrame([(1, rnode, cnode, ctime, "n")], "tree_id int, rnode string, cnode string, ctime double, name string")
        return rows(arg.rearranged(t, m), "node", F.coalesce("parent", F.lit("-")))

    assert after("a", "b", 3.0) == [("a", "n"), ("b", "n"), ("c", "r"), ("n", "r"), ("r", "-")]
    assert after("a", "u", 7.0) == [("a", "n"), ("b", "n"), ("c", "r"), ("n", "r"), ("r", "-")]
    assert after("a", "r", 12.0) == [("a", "n"), ("b", "r"), ("c", "r"), ("n", "-"), ("r", "n")]
    assert after("c", "r", 12.0) == [("a", "u"), ("b", "u"), ("c", "n"), ("n", "-"), ("u", "n")]
    assert after("a", "a", 3.0) == sorted((x[1], x[2] or "-") for x in nodes)


def by_part(spark, g, lo, hi, ages, keep=None):
    """{part's end: clades} of the local trees, of the leaves in keep only."""
    forest: dict = {}
    for r in arg.local_trees(g, arg.blocks(g, lo, hi), lo, hi).collect():
        forest.setdefault(r.tree_id, {})[r.node] = (r.parent, ages[r.node])
    out = {}
    for at, nodes in forest.items():
        cs = {(c & keep if keep else c, a) for c, a in clades(nodes)}
        out[at] = {(c, min(a for d, a in cs if d == c)) for c, _ in cs if c}
    return out


def at(found, x):
    return found[max(p for p in found if p <= x)]


def test_subgraphs_have_the_same_trees(spark):
    data = samplers.recombination_graph(6, 1.0, 1.5, 0.0, 1.0, random.Random(12))
    g = spark.createDataFrame([tuple(r) for r in data], "name string, event string, age double, pos double, parents array<string>")
    ages = {r[0]: r[2] for r in data}
    whole = by_part(spark, g, 0, 1, ages)
    part = arg.subgraph(g, 0.3, 0.6)
    got = by_part(spark, part, 0.3, 0.6, ages)
    assert {r.pos for r in part.where("event = 'recomb'").collect()} <= {r[3] for r in data if 0.3 < r[3] < 0.6}
    assert part.agg(F.sum(F.size("parents"))).first()[0] < sum(len(r[4]) for r in data)
    assert all(at(got, x / 100) == at(whole, x / 100) for x in range(31, 60))
    keep = frozenset(["s0", "s3", "s4"])
    few = arg.subgraph_of(g, spark.createDataFrame([(x,) for x in keep], "name string"))
    assert {r.name for r in few.where("event = 'gene'").collect()} == keep
    kids: dict = {}
    for r in (all_ := few.collect()):
        for p in r.parents:
            kids[p] = kids.get(p, 0) + 1
    assert not [r.name for r in all_ if kids.get(r.name) == 1 and len(r.parents) < 2]
    want = by_part(spark, g, 0, 1, ages, keep)
    got = by_part(spark, few, 0, 1, ages)
    assert all(at(got, x / 100) == at(want, x / 100) for x in range(100))
    assert rows(arg.subgraph_of(g, spark.createDataFrame([(x,) for x in keep], "name string"), keep_single=True).where("event = 'gene'"), "name") == [(x,) for x in sorted(keep)]
    seen = {r.pos for r in arg.visible_recombinations(g, 0, 1).collect()}
    assert seen == {r.pos for r in arg.rearrangements(g, 0, 1).collect()}


def test_graph_lines_come_back(spark, tmp_path):
    parts = spark.createDataFrame([("a", 5, 9), ("a", 1, 3)], "node string, lo long, hi long")
    lines = formats.ancestral_lines(parts, spark.createDataFrame([("a",), ("b",)], "node string"))
    assert rows(lines, "line") == [("a\t1\t3\t5\t9",), ("b",)]
    lines.select("line").write.text(str(tmp_path / "anc"))
    assert rows(formats.read_ancestral(spark, str(tmp_path / "anc")), "node", "lo", "hi") == [("a", 1, 3), ("a", 5, 9)]
    m = spark.createDataFrame([(3.0, 0.5, ["x", "y"]), (4.0, 0.1, [])], "site double, age double, carriers array<string>")
    formats.mutation_lines(m).select("line").write.text(str(tmp_path / "mut"))
    assert rows(formats.read_mutations(spark, str(tmp_path / "mut")), "site", "age", "carriers") == [(3.0, 0.5, ["x", "y"]), (4.0, 0.1, [])]
    t = formats.tree_track_lines(spark.createDataFrame([(0.0, 4.0)], "lo double, hi double"), spark.createDataFrame([("0.0", "(a,b);")], "tree_id string, newick string"))
    t.select("line").write.text(str(tmp_path / "trk"))
    assert rows(formats.read_tree_tracks(spark, str(tmp_path / "trk")), "start", "end", "newick") == [(0, 4, "(a,b);")]


def test_ways_that_trees_share_are_one_row(spark, monkeypatch):
    """A graph of 40 leaves and 30 local trees: rows grow with the graph, not with trees times nodes."""
    n = 40
    data = [(f"l{i}", "gene", 0.0, 0.0, [f"x{i}"]) for i in range(n)] + [("a", "coal", 2.0, 0.0, ["r"]), ("b", "coal", 3.0, 0.0, ["r"]), ("r", "coal", 5.0, 0.0, [])]
    data += [(f"x{i}", "recomb", 1.0, float(i + 1), ["a", "b"]) if i < 30 else (f"x{i}", "coal", 1.0, 0.0, ["a"]) for i in range(n)]
    graph_ = spark.createDataFrame(data, "name string, event string, age double, pos double, parents array<string>")
    sizes, cut = [], arg.graph.cut
    monkeypatch.setattr(arg.graph, "cut", lambda df: sizes.append((out := cut(df)).count()) or out)
    got = rows(arg.length(graph_, 0, 100), "lo", "hi", "branches")
    # left of place i + 1 leaf i is below a; r is the common ancestor where b has a leaf, and a else
    want = [(float(lo), 100.0 if lo == 30 else lo + 1.0, 2.0 * n + lo + (5.0 if lo else 0.0)) for lo in range(31)]
    assert got == want
    assert max(sizes) < 20 * n


def test_rearrangements_list_no_local_trees(spark, monkeypatch):
    """Ways are followed over parts that trees share, also past a leaf that has another one below it."""
    monkeypatch.setattr(arg, "local_trees", None)
    monkeypatch.setattr(arg.trees, "paths", None)
    data = [("a", "gene", 0.0, 0.0, ["m"]), ("m", "gene", 0.5, 0.0, ["x"]), ("x", "recomb", 1.0, 0.4, ["p", "q"]), ("b", "gene", 0.0, 0.0, ["p"])]
    data += [("c", "gene", 0.0, 0.0, ["q"]), ("d", "gene", 0.0, 0.0, ["q"]), ("p", "coal", 2.0, 0.0, ["r"]), ("q", "coal", 3.0, 0.0, ["r"]), ("r", "coal", 4.0, 0.0, [])]
    g = spark.createDataFrame(data, "name string, event string, age double, pos double, parents array<string>")
    assert [tuple(r) for r in arg.rearrangements(g, 0, 1).collect()] == [(0.4, "a", 1.0, "q", 3.0)]
