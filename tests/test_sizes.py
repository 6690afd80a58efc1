"""Steps whose work or numbers grew faster than their tables."""

from pyspark.sql import functions as F

from millrace.operators import ordered, rearrange, stats


def test_squares_of_ranks_leave_ints(spark):
    rows = spark.range(60_000).select(F.lit(1).alias("k"), F.col("id").alias("a"), (-F.col("id")).alias("b"), F.col("id").alias("tie"))
    # opposite orders: 6R is 2n(n^2 - 1)
    n = 60_000
    assert abs(ordered.spearman_z(rows, ["k"], "a", "b", "tie").first()["z"] - (n - 1) ** 0.5) < 1e-6


def test_a_pick_looks_through_a_cell(spark):
    """Every row went through all choices: 20,000 x 20,000 comparisons of structs."""
    choices = spark.range(1, 20_001).select(F.col("id").alias("item"), (F.col("id") % 3).cast("double").alias("w"))
    rows = spark.range(20_000).select("id")
    got = stats.weighted_pick(choices, "item", "w", (F.col("id") % 997) / F.lit(997.0), rows)
    assert "BroadcastNestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    ends, total = [], 0.0
    for i in range(1, 20_001):
        total += i % 3
        ends.append((total, i, i % 3))
    found = {r["id"]: r["item"] for r in got.collect()}
    assert len(found) == 20_000
    for k in (0, 1, 498, 996, 19_999):
        assert found[k] == next(i for hi, i, w in ends if w and hi / total > (k % 997) / 997.0)


def test_picks_at_the_ends(spark):
    choices = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 3.0)], "item int, w double")
    rows = spark.createDataFrame([(0, -1.0), (1, 0.0), (2, 0.25), (3, 0.9), (4, 1.0), (5, float("nan")), (6, None)], "id int, x double")
    got = {r["id"]: r["item"] for r in stats.weighted_pick(choices, "item", "w", F.col("x"), rows).collect()}
    assert got == {0: 1, 1: 1, 2: 3, 3: 3, 4: 3, 5: 3, 6: 3}


def test_the_species_tree_is_built_once_a_task(spark, monkeypatch):
    species = spark.createDataFrame([("top", None), ("a", "top"), ("b", "top")], "node string, parent string")
    nodes = spark.createDataFrame([(1, "r", None, 0.0), *((1, x, "r", 1.0) for x in "xyz")], "tree_id long, node string, parent string, dist double")
    tips = spark.createDataFrame([(1, "x", "a"), (1, "y", "a"), (1, "z", "b")], "tree_id long, node string, species string")
    plan = rearrange.rooted_forest(nodes, species, tips)
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.where("parent is null").count() == 1
