"""What nodes lead to, where nothing leads to some of them."""

import random

import pytest

from millrace.operators import graph


def plain(edges):
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    out = set()
    for n in {x for e in edges for x in e}:
        seen, front, depth = {n: 0}, [n], 0
        while front:
            depth += 1
            front = [m for m in {m for x in front for m in to.get(x, ())} if m not in seen]
            seen |= dict.fromkeys(front, depth)
        out |= {(n, m, k) for m, k in seen.items()}
    return out


@pytest.mark.parametrize("near", [graph.NEAR_PAIRS, 0])
def test_above(spark, monkeypatch, near):
    monkeypatch.setattr(graph, "NEAR_PAIRS", near)
    rng = random.Random(3)
    edges = [(f"p{i}", f"s{rng.randrange(12)}") for i in range(30) for _ in range(3)] + [(f"s{rng.randrange(12)}", f"s{rng.randrange(12)}") for _ in range(14)]
    got = graph.above(spark.createDataFrame([*edges, (None, "s1"), ("p1", None)], "node string, parent string"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain(edges)


def test_first_nodes_take_no_part_in_rounds(spark, monkeypatch):
    sizes, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: sizes.append((out := cut(df)).count()) or out)
    edges = [(f"p{i}", "s8") for i in range(100)] + [(f"s{i}", f"s{i - 1}") for i in range(1, 9)]
    got = graph.above(spark.createDataFrame(edges, "node string, parent string")).count()
    assert got == 100 * 10 + 45 and max(sizes[1:]) < 100


@pytest.mark.parametrize("laid", [1, 7, graph.LAID])
def test_lists_laid_out_in_pieces(spark, monkeypatch, laid):
    """A first node's rows are made once, of the least of its parents' lists, and not of every edge's."""
    monkeypatch.setattr(graph, "LAID", laid)
    rng = random.Random(5)
    edges = [(i, 100 + rng.randrange(15)) for i in range(40) for _ in range(4)] + [(100 + rng.randrange(15), 100 + rng.randrange(15)) for _ in range(25)]
    got = graph.above(spark.createDataFrame(edges, "node long, parent long"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain(edges)
    assert "explode" not in got._jdf.queryExecution().executedPlan().toString()
