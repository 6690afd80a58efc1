"""Tours, common ancestors and extremes below nodes against plain walks over random, deep and wide trees."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import scan, tours


def random_forest(seed, trees=6, n=60):
    """(tree_id, node, parent): bushy, narrow and single-node trees; one id has two roots."""
    rng, out = random.Random(seed), []
    for t in range(trees):
        size = 1 if t == 0 else n
        names = rng.sample(range(1000), size)
        for i, name in enumerate(names):
            up = None if i == 0 or (t == 1 and i == 1) else names[rng.randrange(max(0, i - 1 - t), i)]
            out.append((t, name, up))
    rng.shuffle(out)
    return out


def walked(rows):
    """{(tree, node): (pre, post, size, level, first_leaf, leaves)} by recursion."""
    kids, out = {}, {}
    for t, n, p in rows:
        kids.setdefault((t, p), []).append(n)

    def walk(t, n, level, at):
        pre, first = at[0], at[2]
        at[0] += 1
        below = sorted(kids.get((t, n), []))
        if not below:
            at[2] += 1
        for c in below:
            walk(t, c, level + 1, at)
        out[t, n] = (pre, at[1], at[0] - pre, level, first, at[2] - first)
        at[1] += 1

    for t in {r[0] for r in rows}:
        at = [0, 0, 0]
        for root in sorted(kids.get((t, None), [])):
            walk(t, root, 0, at)
    return out


def met(rows, t, a, b):
    up = {(t_, n): p for t_, n, p in rows}

    def line(x):
        out = []
        while x is not None:
            out.append(x)
            x = up[t, x]
        return out

    one, two = line(a), line(b)
    common = next((x for x in one if x in two), None)
    return None if common is None else (common, one.index(common) + two.index(common))


SCHEMA = "tree_id int, node int, parent int"
NUMBERS = ["pre", "post", "size", "level", "first_leaf", "leaves"]


@pytest.mark.parametrize("seed", [1])
def test_numbers_of_a_tour(spark, seed):
    rows = random_forest(seed)
    got = tours.tour(spark.createDataFrame([*rows, rows[3], (2, None, 5)], SCHEMA), ("tree_id",)).collect()
    assert {(r.tree_id, r.node): tuple(r[c] for c in NUMBERS) for r in got} == walked(rows) and len(got) == len(rows)


@pytest.mark.parametrize("seed", [3])
def test_common_ancestors(spark, seed):
    rows = random_forest(seed)
    rng = random.Random(seed)
    pairs = [(t, *rng.choices([n for t_, n, _ in rows if t_ == t], k=2)) for t in rng.choices(range(6), k=200)] + [(1, 5000, 5001)]
    t = tours.tour(spark.createDataFrame(rows, SCHEMA), ("tree_id",))
    paths = tours.heavy_paths(t, ("tree_id",))
    got = tours.lca(paths, spark.createDataFrame(pairs + pairs[:5], "tree_id int, a int, b int"), by=("tree_id",)).collect()
    want = {(t, a, b): met(rows, t, a, b) for t, a, b in pairs[:-1]}
    assert {(r.tree_id, r.a, r.b): (r.lca, r.distance) for r in got} == {k: v for k, v in want.items() if v} and len(got) == len({k for k, v in want.items() if v})


def test_extremes_below_nodes(spark):
    rows = random_forest(5)
    rng = random.Random(5)
    numbers = walked(rows)
    values = {k: rng.choice([None, *range(100)]) for k, v in numbers.items() if v[2] == 1}
    t = tours.tour(spark.createDataFrame(rows, SCHEMA), ("tree_id",))
    got = tours.extremes(t, spark.createDataFrame([(*k, v) for k, v in values.items()], "tree_id int, node int, v int"), "v", ("tree_id",)).collect()
    assert len(got) == len(rows)
    for r in got:
        pre, _, size, *_ = numbers[r.tree_id, r.node]
        below = [v for k, v in values.items() if k[0] == r.tree_id and pre <= numbers[k][0] < pre + size and v is not None]
        assert (r.low, r.high) == (min(below, default=None), max(below, default=None))


def test_a_chain_of_100_000_nodes(spark):
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    t = tours.tour(chain)
    assert t.where("pre <> node or level <> node or size <> 100000 - node or post <> 99999 - node or first_leaf <> 0 or leaves <> 1").count() == 0 and t.count() == n
    got = tours.lca(tours.heavy_paths(t), spark.createDataFrame([(0, 99_999), (70_000, 5)], "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(0, 99_999, 0, 99_999), (70_000, 5, 5, 69_995)]


def test_a_star_is_scanned_in_pieces(spark, monkeypatch):
    star = spark.range(5000).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.lit(0).cast("long")).alias("parent"))
    cut = []
    before = scan.lay
    monkeypatch.setattr(scan, "lay", lambda *a: cut.append(before(*a)) or cut[-1])
    t = tours.tour(star)
    assert cut[0].pieces and t.where("pre <> node").count() == 0 and t.where("node = 0 and size = 5000 and leaves = 4999").count() == 1


def test_cycles_parents_and_empty_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "node string, parent string")
    with pytest.raises(ValueError, match="cycle"):
        tours.tour(make([("a", "b"), ("b", "c"), ("c", "a"), ("r", None)])).collect()
    with pytest.raises(Exception, match="two parents"):
        tours.tour(make([("r", None), ("s", "r"), ("a", "r"), ("a", "s")])).collect()
    # a parent without a row counts as none
    assert [tuple(r)[:3] for r in tours.tour(make([("a", "gone"), ("b", "a")])).orderBy("pre").collect()] == [("a", None, 0), ("b", "a", 1)]
    none = tours.tour(make([("a", None)]).where("false"))
    assert none.count() == 0 and tours.lca(tours.heavy_paths(none), make([("a", "b")]).toDF("a", "b")).count() == 0
    assert tours.extremes(none, make([("a", "b")]).selectExpr("node", "1 as v"), "v").count() == 0
