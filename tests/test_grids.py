"""Rectangles of very different sizes, and closures of graphs with several parents, against plain loops."""

import random

import pytest

from millrace.operators import graph, intervals


def boxes(seed, n):
    rng, out = random.Random(seed), []
    for i in range(n):
        size = rng.choice([0, 0.001, 0.4, 3, 50, 4000, 1e9])
        x, y = rng.uniform(-500, 500) * rng.choice([1, 1, 1000]), rng.uniform(-500, 500)
        out.append((rng.choice("ab"), i, x, y, x + size * rng.random(), y + size))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rectangles_of_all_sizes(spark, seed):
    a, b = boxes(seed, 250), boxes(seed + 50, 250)
    b += a[:20]
    one = spark.createDataFrame([*a, ("a", 999, None, 0.0, 1.0, 1.0), ("a", 998, float("inf"), 0.0, float("inf"), 1.0)], "k string, i int, x1 double, y1 double, x2 double, y2 double")
    two = spark.createDataFrame(b, "k string, j int, u1 double, v1 double, u2 double, v2 double")
    got = sorted((r.k, r.i, r.j) for r in intervals.rectangle_join(one, two, ["k"]).collect())
    want = sorted((k, i, j) for k, i, x1, y1, x2, y2 in a for m, j, u1, v1, u2, v2 in b if k == m and x2 > u1 and x1 <= u2 and y2 > v1 and y1 <= v2)
    assert got == want and len(want) > 500


@pytest.mark.parametrize("held", [0, 300, intervals.HELD])
def test_rectangles_of_large_keys_meet_on_grids(spark, monkeypatch, held):
    """Of 600 rectangles a key has 300 or so: none, one or both of the keys are held whole."""
    monkeypatch.setattr(intervals, "HELD", held)
    a, b = [(k if i % 7 else "a", *r) for i, (k, *r) in enumerate(boxes(3, 300))], boxes(4, 300)
    one = spark.createDataFrame(a, "k string, i int, x1 double, y1 double, x2 double, y2 double")
    two = spark.createDataFrame(b, "k string, j int, u1 double, v1 double, u2 double, v2 double")
    joined = intervals.rectangle_join(one, two, ["k"])
    want = sorted((k, i, j) for k, i, x1, y1, x2, y2 in a for m, j, u1, v1, u2, v2 in b if k == m and x2 > u1 and x1 <= u2 and y2 > v1 and y1 <= v2)
    assert sorted((r.k, r.i, r.j) for r in joined.collect()) == want
    assert ("_cx" in joined._jdf.queryExecution().optimizedPlan().toString()) == (held < 10_000)


def test_a_wide_rectangle_is_a_few_rows(spark):
    """One across everything beside many small ones: cells would be millions at one width."""
    small = spark.range(2000).selectExpr("id as i", "id * 1000.0 as x1", "id * 1000.0 as y1", "id * 1000.0 + 0.5 as x2", "id * 1000.0 + 0.5 as y2")
    wide = spark.createDataFrame([(0, -1e9, -1e9, 1e9, 1e9)], "j int, u1 double, v1 double, u2 double, v2 double")
    assert intervals.rectangle_join(small, wide, []).count() == 2000
    assert intervals.rectangle_join(small.where("i < 0"), wide, []).count() == 0


def test_closure_of_several_parents(spark):
    rng = random.Random(3)
    edges = [(i, rng.randrange(max(0, i - 12), i)) for i in range(1, 60) for _ in range(3)] + [(100, 101), (101, 102), (102, 100), (7, None), (None, 7), (200, 200)]
    got = {(r.node, r.ancestor): r.depth for r in graph.above(spark.createDataFrame(edges, "node int, parent int")).collect()}
    up = {}
    for a, b in edges:
        if a is not None and b is not None:
            up.setdefault(a, set()).add(b)
            up.setdefault(b, set())
    want = {}
    for n in up:
        front, d = {n}, 0
        while front:
            for x in front:
                want[n, x] = d
            front, d = {y for x in front for y in up[x] if (n, y) not in want}, d + 1
    assert got == want
    assert graph.above(spark.createDataFrame([], "node int, parent int")).count() == 0


def test_a_thousand_ways_are_one_row(spark):
    edges = [("low", f"m{i}") for i in range(1000)] + [(f"m{i}", "top") for i in range(1000)] + [("top", "over")]
    df = graph.above(spark.createDataFrame(edges, "node string, parent string"))
    assert [r.depth for r in df.where("node = 'low' and ancestor = 'top'").collect()] == [2]
    assert [r.depth for r in df.where("node = 'low' and ancestor = 'over'").collect()] == [3]
    assert df.count() == df.select("node", "ancestor").distinct().count() == 1003 + 3 * 1000 + 2 + 1
