"""Trees that are packed one a row: what is worked out of them isn't dealt again."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import clumps, trees
from millrace.plans import driver, forests, rearranged  # noqa: F401

D = "/root/testdata/sf0.001"


def random_nodes(spark, seed, count=12):
    rng, rows = random.Random(seed), []
    for t in range(count):
        names = [f"n{i}" for i in range(rng.randint(2, 12))]
        rows += [(f"t{t}", n, names[rng.randrange(i)] if i else None, float(rng.randint(1, 9))) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "tree_id string, node string, parent string, dist double")


@pytest.mark.parametrize("weighted", [False, True])
def test_lengths_fitted_in_rows(spark, weighted):
    nodes = random_nodes(spark, 5)
    cells = trees.leaf_distances(nodes).withColumn("distance", F.col("distance") + F.length("a") + F.hash("b") % 3)
    beside = cells.groupBy("tree_id").agg(F.collect_list(F.struct(F.col("a").alias("node"), "b", "distance")).alias("beside"))
    got = clumps.unpack(trees.fitted_packed(clumps.pack(nodes).join(beside, "tree_id", "left"), weighted))
    want = {(r.tree_id, r.node): (r.parent, r.dist) for r in trees.fitted_trees(nodes, cells, weighted).union(nodes.join(cells, "tree_id", "left_anti").select("tree_id", "node", "parent", "dist")).collect()}
    got = {(r.tree_id, r.node): (r.parent, r.dist) for r in got.collect()}
    assert got.keys() == want.keys()
    for k, (parent, dist) in want.items():
        assert got[k][0] == parent and got[k][1] == pytest.approx(dist, abs=1e-6)


@pytest.mark.parametrize("most", [clumps.MOST, 6])
def test_splits_of_both(spark, monkeypatch, most):
    monkeypatch.setattr(clumps, "MOST", most)
    one, two = random_nodes(spark, 7), random_nodes(spark, 8)
    both = clumps.pack(one).join(clumps.pack(two, "other"), "tree_id")
    want = {r.tree_id: r.error for r in trees.robinson_foulds(one, two).collect()}
    assert {r.tree_id: r.error for r in trees.robinson_foulds_of_both(both).collect()} == want
    same = clumps.pack(one).withColumn("other", F.col("own"))
    assert {r.error for r in trees.robinson_foulds_of_both(same).collect()} == {0.0}


@pytest.mark.parametrize("name", ["fitted_lengths", "robinson_foulds", "split_relations", "tree_splits"])
def test_written_trees_are_not_dealt(spark, name):
    plan = driver.QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMerge" not in plan


def test_strings_of_trees_take_one_shuffle(spark):
    for name in ("kept_leaves", "tree_topology"):
        assert driver.QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1


@pytest.mark.parametrize(("most", "seed"), [(clumps.MOST, 11), (6, 12)])
def test_accuracy_of_both(spark, monkeypatch, most, seed):
    """Trees of one row are compared as trees of two tables are, also where leaves differ, lack a species or hang below single children."""
    monkeypatch.setattr(clumps, "MOST", most)
    rng = random.Random(seed)
    species = [("s0", None)] + [(f"s{i}", f"s{rng.randrange(i)}") for i in range(1, 9)]
    one, two, tips = [], [], []
    for t in range(30):
        names = [f"l{i}" for i in range(rng.randint(2, 7))]
        for rows in (one, two):
            inner = [f"o{i}" for i in range(rng.randint(1, 4))]
            rows += [(f"t{t}", n, inner[rng.randrange(i)] if i else None, 1.0) for i, n in enumerate(inner)]
            rows += [(f"t{t}", n, rng.choice(inner), 1.0) for n in names if rng.random() < 0.9 or n == "l0"]
        tips += [(f"t{t}", n, f"s{rng.randrange(9)}") for n in names if rng.random() < 0.9]
    node = "tree_id string, node string, parent string, dist double"
    one, two = spark.createDataFrame(one, node), spark.createDataFrame(two, node)
    species, tips = spark.createDataFrame(species, "node string, parent string"), spark.createDataFrame(tips, "tree_id string, node string, species string")
    numbered = trees.Numbered(species, lost=True)
    marked = numbered.mark(tips).groupBy("tree_id").agg(F.collect_list(F.struct("node", "pre", "route")).alias("tips"))
    both = clumps.pack(one).join(clumps.pack(two, "other"), "tree_id").join(marked, "tree_id", "left")
    got, want = trees.accuracy_of_both(both, numbered, species), trees.accuracy(one, two, species, tips)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_accuracy_deals_trees_once(spark):
    plan = driver.QUERIES["tree_accuracy"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
