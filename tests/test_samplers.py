import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from millrace.functions import population, samplers
from millrace.operators import arg, trees


def test_frequency_density_leaves_what_isnt_fixed(spark):
    grid = spark.range(2000).select(((F.col("id") + 0.5) / 2000).alias("x"))
    for p, t in ((0.3, 40.0), (0.5, 100.0)):
        inside = grid.agg(F.sum(samplers.frequency_density(F.col("x"), F.lit(p), 100, t, 60)) / 2000).first()[0]
        ends = spark.range(1).select(*(population.prob_fixation(F.lit(q), F.lit(100.0), F.lit(t)) for q in (p, 1 - p))).first()
        assert inside + sum(ends) == pytest.approx(1, abs=1e-4)


def test_frequencies_drift_without_direction(spark):
    rows = spark.range(600).select(F.col("id").alias("seed"), F.lit(0.4).alias("p"), F.lit(50).alias("n"))
    got = samplers.sample_frequencies(rows, "p", "n", 30, "seed", "f")
    vals = [r.f for r in got.collect()]
    assert statistics.mean(vals) == pytest.approx(0.4, abs=0.05)
    assert statistics.pvariance(vals) == pytest.approx(0.24 * (1 - (1 - 1 / 100) ** 30), rel=0.25)
    assert vals == [r.f for r in got.collect()]


def test_chances_of_counts_sum_to_one():
    for t in (0.1, 3.0):
        assert sum(samplers.chance_of_counts(6, b, t, 2.0) for b in range(1, 7)) == pytest.approx(1)


def test_bounded_times_match_rejection():
    rng = random.Random(1)

    def free():
        while True:
            t, out = 0.0, []
            for k in (4, 3, 2):
                t += rng.expovariate(k * (k - 1) / 2 / 10)
                out.append(t)
            if t < 12:
                return out

    a = [free() for _ in range(3000)]
    b = [samplers.times_given(4, 1, 10, 12, rng) for _ in range(3000)]
    for i in range(3):
        assert statistics.mean(x[i] for x in b) == pytest.approx(statistics.mean(x[i] for x in a), rel=0.06)
    assert all(x == sorted(x) and x[-1] <= 12 for x in b)
    assert samplers.times_given(3, 3, 10, 5, rng) == []


def test_bounded_times_rows(spark):
    rows = spark.createDataFrame([(1, 4), (2, 1)], "seed long, k int").withColumn("n", F.lit(10)).withColumn("u", F.lit(8.0))
    got = samplers.sample_times_given(rows, "k", "n", "u", "seed")
    assert [(r.seed, r.lineages) for r in got.collect()] == [(1, 4), (1, 3), (1, 2)]
    assert got.collect() == got.collect()


def test_birth_death_trees(spark):
    rng = random.Random(3)
    sizes = []
    for _ in range(1500):
        rows = samplers.birth_death_tree(2.0, 0.6, 0.2, rng)
        up = {x: p for x, p, _ in rows}
        tips = set(up) - set(up.values())
        sizes.append(len(tips))
        far = {}
        for x, p, d in rows:
            far[x] = d + (far[p] if p is not None else 0.0)
        assert all(far[x] == pytest.approx(2.0) for x in tips)
    assert statistics.mean(sizes) == pytest.approx(math.exp(0.4 * 2), rel=0.1)
    df = samplers.sample_birth_death_trees(spark.range(20).withColumn("u", F.lit(1.0)), "u", 1.0, 0.0, "id")
    assert df.select("tree_id").distinct().count() == 20 and df.where("parent is null").count() == 20
    assert samplers.sample_birth_death_trees(spark.range(3).withColumn("u", F.lit(9.0)), "u", 0.0, 50.0, "id").count() == 0


def test_graphs(spark):
    rows = spark.range(8).withColumn("k", F.lit(4)).withColumn("n", F.lit(100.0))
    g = samplers.sample_graphs(rows, "k", "n", 0.01, "id", 0.0, 10.0)
    assert g.collect() == g.collect()
    seen = {}
    for r in g.collect():
        seen.setdefault(r.graph, {})[r.name] = r
    for nodes in seen.values():
        for r in nodes.values():
            assert all(nodes[p].age >= r.age for p in r.parents)
            assert len(r.parents) == 2 if r.event == "recomb" else len(r.parents) <= 1
    one = g.where("graph = 3")
    # every local tree leads from the four samples to one root
    local = arg.local_trees(one, arg.blocks(one, 0, 10), 0, 10).where("parent is null").groupBy("tree_id").count().collect()
    assert local and all(r["count"] == 1 for r in local)
    assert {r.event for r in g.collect()} == {"gene", "coal", "recomb"}


def test_graphs_without_recombination_have_coalescent_ages():
    rng = random.Random(5)
    tops = [max(r[2] for r in samplers.recombination_graph(5, 10, 0.0, 0, 1, rng)) for _ in range(2000)]
    assert statistics.mean(tops) == pytest.approx(2 * 10 * (1 - 1 / 5), rel=0.06)


def test_mutations(spark):
    b = spark.range(300).select(F.concat(F.lit("n"), F.col("id")).alias("child"), F.lit("p").alias("parent"), F.lit(0.0).alias("lo"), F.lit(5.0).alias("hi"), F.lit(1.0).alias("young"), F.lit(3.0).alias("old"))
    m = samplers.sample_mutations(b, 0.4, 7)
    assert m.count() == pytest.approx(1200, rel=0.1)
    assert m.where("pos between 0 and 5 and age between 1 and 3").count() == m.count()
    assert sorted(m.collect()) == sorted(samplers.sample_mutations(b.repartition(3), 0.4, 7).collect())


def test_gene_trees(spark):
    species = trees.Tree([("r", None, 0.5), ("ab", "r", 1.0), ("a", "ab", 1.0), ("b", "ab", 1.0), ("c", "r", 2.0)])
    plain = samplers.gene_tree(species, 0.0, 0.0, random.Random(1))
    assert trees.topology(plain, lambda n: n.split("_")[0]) == "((a,b),c)"
    assert sorted(d for _, p, d in plain.rows() if p is not None) == [1.0, 1.0, 1.0, 2.0]
    assert samplers.gene_tree(species, 0.0, 80.0, random.Random(1)) is None
    rng, sizes = random.Random(2), []
    for _ in range(1500):
        t = samplers.gene_tree(species, 0.5, 0.3, rng)
        sizes.append(len(t.leaves()) if t else 0)
        if t and len(t.leaves()) > 1:
            assert all(len(k) != 1 for k in t.kids.values())
            far = {}
            for n in t.preorder():
                far[n] = 0.0 if n == t.root else far[t.parent[n]] + t.dist[n]
            assert max(far[n] for n in t.leaves()) == pytest.approx(min(far[n] for n in t.leaves()))
    # three species, each after 2.5 of growth at 0.2
    assert statistics.mean(sizes) == pytest.approx(3 * math.exp(0.2 * 2.5), rel=0.1)
    df = samplers.sample_gene_trees(spark.range(5), spark.createDataFrame(species.rows(), "node string, parent string, dist double"), 0.5, 0.0, "id")
    assert df.where("parent is null").count() == 5 and df.collect() == df.collect()


def test_frequency_between_is_the_density_summed(spark):
    grid = spark.range(2000).select(((F.col("id") + 0.5) / 2000).alias("x"))
    for low, high in ((0.0, 1.0), (0.2, 0.7)):
        want = grid.where(F.col("x").between(low, high)).agg(F.sum(samplers.frequency_density(F.col("x"), F.lit(0.3), 100, 60.0, 60)) / 2000).first()[0]
        got = spark.range(1).select(samplers.frequency_between(F.lit(0.3), F.lit(low), F.lit(high), 100, 60.0)).first()[0]
        assert got == pytest.approx(want, abs=2e-3)


def test_conditional_chances_are_their_densities_summed(spark):
    grid = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    k, b, n, t = F.lit(5), F.lit(2), 1.5, 2.0
    x = F.col("u") * 0.8
    pairs = [
        (population.prob_bounded_coal(x, k, n, F.lit(t)), population.cdf_bounded_coal(F.lit(0.8), k, n, F.lit(t))),
        (population.prob_coal_cond_counts(x, k, b, F.lit(t), n), population.cdf_coal_cond_counts(F.lit(0.8), k, b, F.lit(t), n)),
    ]
    for density, cdf in pairs:
        assert grid.agg(F.sum(density) * 0.8 / 4000).first()[0] == pytest.approx(spark.range(1).select(cdf).first()[0], abs=1e-4)
    for birth, death in ((0.8, 0.3), (0.5, 0.5)):
        full = F.col("u") * t
        seen = grid.agg(F.sum(population.birth_wait_time(full, F.lit(3), F.lit(t), birth, death)) * t / 4000).first()[0]
        none = spark.range(1).select(population.prob_no_birth(F.lit(3), F.lit(t), birth, death)).first()[0]
        assert seen + none == pytest.approx(1, abs=1e-4)


def test_lineages_meet_before_a_bound(spark):
    from millrace.operators import rearrange

    species = spark.createDataFrame([("r", None, 1.5, 2.0), ("u", "r", 0.7, 1.0), ("a", "u", 0.0, 1.0), ("b", "u", 0.0, 0.5), ("c", "r", 0.0, 3.0)], "node string, parent string, age double, n double")
    counts = spark.createDataFrame([(1, "a", 1), (1, "c", 1), (2, "a", 3), (2, "b", 2), (2, "c", 2), (3, "b", 1)], "tree_id int, snode string, n int")
    got = {r.tree_id: math.exp(r.log_p) for r in rearrange.log_met_before(counts, species, 4.0).collect()}
    assert got[1] == pytest.approx(1 - math.exp(-2.5 / 2.0)) and got[3] == pytest.approx(1)
    rng, hits, tries = random.Random(8), 0, 8000

    def left(k, span, n):
        while k > 1 and (w := rng.expovariate(k * (k - 1) / 2 / n)) < span:
            k, span = k - 1, span - w
        return k

    for _ in range(tries):
        u = left(left(3, 0.7, 1.0) + left(2, 0.7, 0.5), 0.8, 1.0)
        hits += left(u + left(2, 1.5, 3.0), 2.5, 2.0) == 1
    assert got[2] == pytest.approx(hits / tries, abs=0.025)
    free = {r.tree_id: r.log_p for r in rearrange.log_met_before(counts, species, None).collect()}
    assert free[2] == pytest.approx(0, abs=1e-9)
