"""Scans of keys that are cut into pieces against plain windows, and the operators on them with one hot key."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import intervals, ordered, scan

ROWS = "k string, a int, b int, v int, x double, i int"


def rows(n=3000, seed=1):
    """Most rows under one key, some under null and few under others; nulls in order columns and values."""
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 8 + [None, "p", "q"]), rng.choice([None, *range(40)]), rng.randrange(9), rng.choice([None, 1, 2, 3]), rng.random(), i) for i in range(n)]


def folded(df, by, tasks):
    laid = scan.lay(df, by, ["a", "b", "i"], tasks)
    laid = laid.add(t=scan.total("v"), m=scan.largest_before("v"), n=scan.place(), p=scan.previous("v"), f=scan.following("v"))
    # a second fold sees the first one's columns
    laid = laid.with_columns(new=F.coalesce(F.col("p.v"), F.lit(0)) % 2).add(run=scan.total("new")).add(up=scan.previous("run"))
    return laid


@pytest.mark.parametrize("by", [["k"], [], ["k", "b"]])
def test_pieces_as_plain_windows(spark, by):
    df = spark.createDataFrame(rows(), ROWS).repartition(5)
    plain, cut = folded(df, by, 1), folded(df, by, 7)
    assert not plain.pieces and cut.pieces == (by != ["k", "b"] or cut.pieces)
    assert plain.done().schema == cut.done().schema
    assert sorted(map(str, plain.done().collect())) == sorted(map(str, cut.done().collect()))


def test_a_hot_key_spreads(spark):
    df = spark.createDataFrame(rows(), ROWS)
    laid = scan.lay(df, ["k"], ["a", "i"], 16)
    sizes = [r["count"] for r in laid.rows.where("k = 'hot'").groupBy("_piece").count().collect()]
    share = 3000 / 16
    assert len(sizes) >= 9 and max(sizes) < 2.5 * share
    assert laid.rows.where("k <> 'hot'").agg(F.max("_piece")).first()[0] <= 2
    # the scan's windows are dealt by key and piece
    plan = laid.add(n=scan.place()).done()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_piece" in plan


def test_equal_orders_and_empty_tables(spark):
    df = spark.createDataFrame([("k", 1, 0, v, 0.0, 0) for v in range(50)], ROWS)
    laid = scan.lay(df, ["k"], ["a"], 5).add(n=scan.place(), t=scan.total("v"))
    got = laid.done().orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(50)) and got[-1]["t"] == sum(range(50))
    none = scan.lay(df.where("false"), ["k"], ["a"], 5).add(n=scan.place())
    assert not none.pieces and none.done().count() == 0


@pytest.fixture
def many_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def spans(seed, n=800):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.randrange(4000)
        out.append((rng.choice(["hot"] * 9 + ["cold"]), i, s, s + rng.randrange(1, 12)))
    return out


def covered(of):
    return {p for _, _, s, e in of for p in range(s, e)}


def test_union_of_a_hot_key(spark, many_tasks):
    given = spans(1)
    got = intervals.union(spark.createDataFrame(given, "k string, id int, s int, e int"), ["k"], "id").collect()
    for key in ("hot", "cold"):
        mine, want = sorted((r.s, r.e, r.n) for r in got if r.k == key), []
        for _, _, s, e in sorted(x for x in given if x[0] == key) and sorted((x for x in given if x[0] == key), key=lambda x: (x[2], x[1])):
            if want and s <= want[-1][1]:
                want[-1] = (want[-1][0], max(e, want[-1][1]), want[-1][2] + 1)
            else:
                want.append((s, e, 1))
        assert mine == want


def test_coverage_and_subtraction_of_a_hot_key(spark, many_tasks):
    a, b = spans(2), spans(3, 300)
    one, two = (spark.createDataFrame(x, "k string, id int, s int, e int") for x in (a, b))
    depth = intervals.coverage(one, ["k"]).collect()
    left = intervals.subtract(one, two, ["k"]).collect()
    for key in ("hot", "cold"):
        of_a, of_b = ([x for x in y if x[0] == key] for y in (a, b))
        at = {p: sum(s <= p < e for _, _, s, e in of_a) for p in range(4020)}
        assert {p: r.depth for r in depth if r.k == key for p in range(r.s, r.e)} == {p: n for p, n in at.items() if min(x[2] for x in of_a) <= p < max(x[3] for x in of_a)}
        mine = sorted((r.s, r.e) for r in left if r.k == key)
        assert {p for s, e in mine for p in range(s, e)} == covered(of_a) - covered(of_b)
        assert all(e < s for (_, e), (s, _) in zip(mine, mine[1:], strict=False))


def test_runs_of_a_hot_key(spark, many_tasks):
    given = sorted(rows(1500), key=lambda r: r[5])
    df = spark.createDataFrame(given, ROWS)
    first = {r.i for r in ordered.uniq(df, ["k"], ["i"], "v").collect()}
    runs = sorted((str(r.k), r.start, r.v, r.n) for r in ordered.islands(df, ["k"], ["i"], "v").collect())
    sums = {r.i: r.s for r in ordered.cumsum(df, ["k"], ["i"], "x", "s").collect()}
    want, starts = [], set()
    for key in ("hot", None, "p", "q"):
        total, last, mine = 0.0, object(), [r for r in given if r[0] == key]
        for at, r in enumerate(mine):
            total += r[4]
            assert abs(sums[r[5]] - total) < 1e-9
            if r[3] != last:
                starts.add(r[5])
                want.append([str(key), at, r[3], 0])
            want[-1][3] += 1
            last = r[3]
    assert first == starts and runs == sorted(map(tuple, want))
