"""Trees worked out together in arrays give what joins over the whole forest give, over a shuffle or two."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import clumps, graph, rearrange, trees


def forest(seed, n_trees):
    """Trees of up to 12 nodes, some with nodes of one child and some with nodes of many."""
    rng = random.Random(seed)
    rows = []
    for t in range(n_trees):
        names = rng.sample([f"x{i}" for i in range(99)], rng.randrange(1, 13))
        rows += [(t, n, None if not i else rng.choice(names[:i]), round(rng.uniform(0, 3), 2)) for i, n in enumerate(names)]
    return rows


@pytest.fixture(scope="module")
def both(spark):
    nodes = graph.cut(spark.createDataFrame(forest(5, 60), "tree_id long, node string, parent string, dist double"))
    return nodes


def same(a, b):
    rows = lambda df: sorted(tuple(str(round(v, 6) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in df.select(*sorted(df.columns)).collect())
    got = rows(a)
    assert got == rows(b) and got


def test_same_as_joins(both):
    same(trees.leaf_distances(both), trees._far_distances(both))
    same(trees.ages(both), trees._far_ages(both))
    same(trees.splits(both), trees._far_splits(both, False))
    same(trees.splits(both, True), trees._far_splits(both, True))


def test_larger_trees_are_joined(both, monkeypatch):
    want = graph.cut(trees.leaf_distances(both))
    monkeypatch.setattr(clumps, "MOST", 7)
    same(trees.leaf_distances(both), want)


def test_one_shuffle_for_pairs(both):
    """Closures and joins by node shuffled every ancestor of every node several times."""
    plan = trees.leaf_distances(both)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_losses_are_counted_without_their_rows(spark):
    """A way up past a node of 5,000 children loses 4,999 of them: summed up the species tree they are one row."""
    species = spark.createDataFrame([("top", None), ("n", "top"), ("m", "top"), *((f"s{i}", "n") for i in range(5000))], "node string, parent string")
    nodes = spark.createDataFrame([(1, "r", None), (1, "a", "r"), (1, "b", "r")], "tree_id long, node string, parent string")
    recon = spark.createDataFrame([(1, "a", "s7", "gene"), (1, "b", "m", "gene"), (1, "r", "top", "spec")], "tree_id long, node string, snode string, event string")
    assert [(r.node, r.n) for r in trees.loss_counts(nodes, species, recon).collect()] == [("a", 4999)]
    lost = {r.snode: r.lost for r in trees.event_counts(nodes, species, recon).where(F.col("lost") > 0).collect()}
    assert len(lost) == 4999 and "s7" not in lost


def test_cycles_and_two_parents_are_errors(spark):
    schema = "tree_id long, node string, parent string, dist double"
    for rows in ([(1, "a", "b", 1.0), (1, "b", "a", 1.0)], [(1, "a", None, 1.0), (1, "a", "b", 1.0), (1, "b", None, 1.0)]):
        with pytest.raises(Exception, match="cycle|two parents"):
            trees.ages(spark.createDataFrame(rows, schema)).collect()


def test_losses_of_wide_species_are_compared_by_number(spark):
    """Each tree's 2 x 1,999 losses are two numbers; the plan has no row for each."""
    species = spark.createDataFrame([("top", None), ("n", "top"), ("m", "top"), *((f"s{i}", "n") for i in range(2000)), ("m0", "m")], "node string, parent string")
    nodes = spark.createDataFrame([(1, "r", None, 0.0), (1, "a", "r", 1.0), (1, "b", "r", 1.0)], "tree_id long, node string, parent string, dist double")
    tips = spark.createDataFrame([(1, "a", "s7"), (1, "b", "m0")], "tree_id long, node string, species string")
    got = trees.accuracy(nodes, nodes, species, tips)
    assert "lost" not in got._jdf.queryExecution().optimizedPlan().toString()
    row = got.first()
    assert (row["loss_actual"], row["loss_pred"], row["loss_sn"], row["loss_ppv"]) == (1999, 1999, 1.0, 1.0)


SPECIES = [("top", None), ("n", "top"), ("m", "top"), *((f"s{i}", "n" if i % 3 else "m") for i in range(9))]


def packed_and_flat(spark):
    """Random trees with species at their leaves: packed with their places in the species tree, and as rows."""
    rng = random.Random(8)
    rows = forest(6, 50)
    inner = {(t, p) for t, _, p, _ in rows}
    species = spark.createDataFrame(SPECIES, "node string, parent string")
    nodes = graph.cut(spark.createDataFrame(rows, "tree_id long, node string, parent string, dist double"))
    tips = graph.cut(spark.createDataFrame([(t, n, f"s{rng.randrange(9)}") for t, n, _, _ in rows if (t, n) not in inner], "tree_id long, node string, species string"))
    numbered = trees.Numbered(species)
    marked = nodes.join(numbered.mark(tips), trees.ID, "left").select("tree_id", "node", "parent", "dist", "pre", "route")
    return nodes, tips, species, numbered, graph.cut(clumps.pack(marked))


def test_packed_trees_are_not_dealt_again(spark):
    """A forest's rows were dealt by tree, with those of the reconciliation, for every operator; packed they are dealt once."""
    nodes, tips, species, numbered, packed = packed_and_flat(spark)
    recon = trees.reconcile_packed(packed, numbered)
    for out in (recon.rows(), trees.branches(packed, recon), trees.relations(packed, recon), rearrange.species_roots(packed, species, recon), rearrange.split_early(packed, species, recon)):
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [1000, 9])
def test_packed_gives_what_rows_give(spark, monkeypatch, most):
    nodes, tips, species, numbered, packed = packed_and_flat(spark)
    want = graph.cut(trees.reconcile(nodes, species, tips))
    monkeypatch.setattr(clumps, "MOST", most)
    recon = trees.reconcile_packed(packed, numbered)
    same(recon.rows(), want)
    monkeypatch.setattr(clumps, "MOST", 1000)
    for f in (rearrange.species_roots, rearrange.split_early):
        same(f(packed, species, recon), f(nodes, species, want))
    for f in (trees.branches, trees.relations, lambda n, r: trees.relations(n, r, "dup", "top")):
        same(f(packed, recon), f(nodes, want))
