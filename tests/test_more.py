import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import geometry
from millrace.operators import intervals, rearrange, relational, stats


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_brackets_against_all_rows(spark):
    rng = random.Random(6)
    table = [(rng.choice("ab"), rng.choice([None, *range(40)])) for _ in range(60)]
    mine = [(rng.choice("abc"), rng.choice([None, *range(-3, 45)]), i) for i in range(80)]
    got = relational.brackets(spark.createDataFrame(mine, "k string, x int, i int"), spark.createDataFrame(table, "k string, v int"), ["k"], "x", "v")
    assert got.columns == ["k", "x", "i", "below", "above"]
    for r in got.collect():
        near = [v for k, v in table if k == r.k and v is not None and r.x is not None]
        assert r.below == max((v for v in near if v <= r.x), default=None)
        assert r.above == min((v for v in near if v >= r.x), default=None)
    assert got.count() == 80


def test_segments(spark):
    df = spark.createDataFrame([("k", 1, 0, 10), ("k", 2, 5, 7), ("k", 3, 20, 25), ("k", 4, 3, 3)], "k string, id int, s int, e int")
    got = sorted((r.s, r.e, r.n, r.ids) for r in intervals.segments(df, ["k"], "id", 4).collect())
    assert got == [(0, 3, 1, [1]), (3, 5, 1, [1]), (5, 7, 2, [1, 2]), (7, 10, 1, [1]), (20, 25, 1, [3])]
    assert sorted((r.id, r.s, r.e) for r in intervals.clip(df, 6, False).collect()) == [(1, 6, 10), (2, 6, 7), (3, 20, 25)]


def test_divergence_without_q_is_infinite(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("b", 0, 4), ("b", 2, 4), ("c", 0, 0)], "k string, p int, q int")
    got = {r.k: (r.cross_entropy, r.kl) for r in stats.divergence(df, "p", "q", ["k"]).collect()}
    assert got == {"a": (float("inf"), float("inf")), "b": (1.0, 1.0)}


def test_curves(spark):
    points = F.array(*map(F.lit, (1.0, 5.0, 2.0, 2.0)))
    got = one(spark, *(geometry.interpolated(points, F.lit(x)).alias(f"x{i}") for i, x in enumerate((0.0, 1.0, 2.0, 3.0, 3.5, 0.5))))
    assert got[:5] == (1.0, 5.0, 2.0, 2.0, None)
    # by hand: the slopes at 0 and 1 are 2 and 0.5
    assert got.x5 == pytest.approx(3 + (2 - 0.5) / 8)
    assert one(spark, geometry.interpolated(F.array(F.lit(4.0)), F.lit(0.0)))[0] == 4.0


def test_shapes(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (2.0, 1.0), (3.0, 3.0)], "x double, y double")
    for xs, ys in (([0, 2, 2, 0], [0, 0, 2, 2]), ([0, 0, 2, 2], [0, 2, 2, 0])):
        assert [r[0] for r in df.select(geometry.in_convex(xs, ys, F.col("x"), F.col("y"))).collect()] == [True, True, True, False]
    with pytest.raises(ValueError):
        geometry.in_convex([0, 1], [0, 1], F.col("x"), F.col("y"))


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(5.0))
    got = one(spark, geometry.vector(a, b, lambda x, y: x * y).alias("p"), geometry.vector(a, 2, lambda x, y: x - y).alias("s"))
    assert (got.p, got.s) == ([3.0, 10.0], [-1.0, 0.0])
    with pytest.raises(Exception, match="unequal length"):
        one(spark, geometry.vector(a, F.array(F.lit(1.0)), lambda x, y: x + y))


def test_splits(spark):
    rng = random.Random(8)
    leaves = list("abcdef")
    rows = [(sorted(rng.sample(leaves, rng.randrange(1, 6))), sorted(rng.sample(leaves, rng.randrange(1, 6))), leaves) for _ in range(60)] + [(["a"], ["a"], leaves)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, l array<string>")
    for r in df.select("a", "b", geometry.split_relation(F.col("a"), F.col("b")).alias("rel"), geometry.splits_fit(F.col("a"), F.col("b"), F.col("l")).alias("fit")).collect():
        a, b = set(r.a), set(r.b)
        assert r.rel == ("disjoint" if not a & b else "equal" if a == b else "child" if a < b else "parent" if a > b else "conflict")
        assert r.fit == (len({(x in a, x in b) for x in leaves}) < 4)


def test_consistency_and_relabelling(spark):
    nodes = spark.createDataFrame([("t", "r", None), ("t", "x", "r"), ("t", "y", "r"), ("t", "a1", "x"), ("t", "b1", "x"), ("t", "a2", "y"), ("t", "c1", "y")], "tree_id string, node string, parent string")
    recon = spark.createDataFrame([("t", n, s, e) for n, s, e in (("r", "all", "dup"), ("x", "all", "dup"), ("y", "all", "spec"), ("a1", "a", "gene"), ("b1", "b", "gene"), ("a2", "a", "gene"), ("c1", "c", "gene"))], "tree_id string, node string, snode string, event string")
    got = rearrange.duplication_consistency(nodes, recon)
    assert {r.node: r.consistency for r in got.collect()} == {"r": pytest.approx(1 / 3), "x": 0.0}
    assert {r.node: r.event for r in rearrange.relabelled(recon, got).collect() if r.node in "rxy"} == {"r": "dup", "x": "spec", "y": "spec"}


def test_block_best(spark):
    hits = spark.createDataFrame([(1, "p", "x", 5.0), (1, "p", "y", 4.0), (1, "q", "y", 4.0), (2, "p", "y", 1.0)], "block int, a string, b string, score double")
    got = {r.block: (r.n, r.total) for r in relational.block_best(hits, "block", "a", "b", "score").collect()}
    # in block 1, y's tie goes to p, whose best is x
    assert got == {1: (1, 5.0), 2: (1, 1.0)}
