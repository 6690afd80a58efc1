import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import population as P
from millrace.functions import special as X
from millrace.operators import align, hmm, trees


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def aln(spark, *seqs):
    return spark.createDataFrame([("x", f"s{i}", s) for i, s in enumerate(seqs)], "aln_id string, name string, seq string")


def seqs(df):
    return [r.seq for r in df.orderBy("name").collect()]


def test_special_functions(spark):
    xs = [0.3, 1.0, 2.5, 7.0, 40.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    x = F.col("x")
    got = df.select("x", X.log_gamma(x), X.erf(x), X.erf(-x), X.gamma_inc(F.lit(2.0), x), X.normal_cdf(x, 1, 2), X.chi_square_tail(x, F.lit(2.0)), X.poisson_cdf(F.floor(x), 3.0)).collect()
    for r in got:
        v = r[0]
        assert r[1] == pytest.approx(math.lgamma(v), rel=1e-12, abs=1e-12)
        assert r[2] == pytest.approx(math.erf(v)) and r[3] == pytest.approx(-math.erf(v))
        assert r[4] == pytest.approx(1 - (1 + v) * math.exp(-v))
        assert r[5] == pytest.approx((1 + math.erf((v - 1) / math.sqrt(8))) / 2)
        assert r[6] == pytest.approx(math.exp(-v / 2), abs=1e-12)
        assert r[7] == pytest.approx(sum(3.0**k * math.exp(-3) / math.factorial(k) for k in range(int(v) + 1)))


def test_logs_tails_and_roots(spark):
    r = one(spark, X.log_add(F.lit(math.log(3.0)), F.lit(math.log(4.0))), X.log_sub(F.lit(math.log(7.0)), F.lit(math.log(4.0))), X.choose(F.lit(10), F.lit(3)), X.choose(F.lit(3), F.lit(5)), X.hypergeometric_tail(F.lit(3), F.lit(5), F.lit(6), F.lit(20)))
    tail = sum(math.comb(6, k) * math.comb(14, 5 - k) for k in (3, 4, 5)) / math.comb(20, 5)
    assert list(r) == pytest.approx([math.log(7), math.log(3), 120, 0, tail])
    for roots in ((1.0, 2.0, 5.0), (-3.0, 0.5, 4.0)):
        a, b, c = -sum(roots), sum(x * y for x, y in itertools.combinations(roots, 2)), -math.prod(roots)
        assert one(spark, X.cubic_roots(*(F.lit(v) for v in (a, b, c))))[0] == pytest.approx(list(roots))
    assert one(spark, X.cubic_roots(F.lit(0.0), F.lit(1.0), F.lit(-10.0)))[0] == pytest.approx([2.0])
    assert one(spark, X.likelihood_ratio(F.lit(-10.0), F.lit(-8.0), 2), X.likelihood_ratio(F.lit(-10.0), F.lit(-8.0), 1, halved=True)) == pytest.approx((math.exp(-2), math.erfc(math.sqrt(2)) / 2))


def test_coalescent(spark):
    k, t = F.lit(5), F.lit(300.0)
    counts = [P.prob_coal_counts(k, F.lit(b), t, 1000) for b in range(1, 6)]
    assert sum(one(spark, *counts)) == pytest.approx(1)
    assert one(spark, P.prob_coal_counts(k, F.lit(5), t, 1000))[0] == pytest.approx(math.exp(-10 * 0.3))
    assert one(spark, P.cdf_mrca(F.lit(700.0), F.lit(2), 1000))[0] == pytest.approx(1 - math.exp(-0.7))
    slope = one(spark, (P.cdf_mrca(F.lit(500.1), k, 1000) - P.cdf_mrca(F.lit(499.9), k, 1000)) / 0.2, P.prob_mrca(F.lit(500.0), k, 1000))
    assert slope[0] == pytest.approx(slope[1], rel=1e-4)
    df = spark.range(2000).select((F.col("id") + 0.5).alias("x"))
    assert df.agg(F.sum(P.prob_coal_cond_counts(F.col("x"), F.lit(4), F.lit(2), F.lit(2000.0), 1000))).first()[0] == pytest.approx(1, abs=1e-3)
    assert df.agg(F.sum(P.prob_bounded_coal(F.col("x"), F.lit(3), 1000, F.lit(2000.0)))).first()[0] == pytest.approx(1, abs=1e-3)
    assert one(spark, P.log_labelled_histories(F.lit(4), F.lit(1)))[0] == pytest.approx(math.log(18))
    times = spark.createDataFrame([("a", 3, 10.0), ("a", 2, 50.0)], "id string, k int, t double")
    assert P.popsize_of_times(times, ["id"]).first()["n"] == pytest.approx((10 * 3 + 40 * 1) / 2)
    fix = one(spark, P.prob_fixation(F.lit(0.3), F.lit(100.0), F.lit(1e6)), P.prob_fixation(F.lit(0.3), F.lit(100.0), F.lit(20.0)))
    assert fix[0] == pytest.approx(0.3) and -1e-6 < fix[1] < 1e-3
    assert (P.num_rooted_trees(4), P.num_unrooted_trees(5), P.num_rooted_trees(2)) == (15, 15, 1)


@pytest.mark.parametrize("birth,death", [(0.3, 0.1), (0.2, 0.2), (0.1, 0.4), (0.0, 0.2)])
def test_birth_death(spark, birth, death):
    t = F.lit(2.0)
    p = one(spark, *(P.prob_birth_death1(F.lit(g), t, birth, death) for g in range(40)))
    assert sum(p) == pytest.approx(1, abs=1e-6)
    assert sum(i * x for i, x in enumerate(p)) == pytest.approx(math.exp((birth - death) * 2), abs=1e-4)
    two = one(spark, *(P.prob_birth_death(F.lit(2), F.lit(g), t, birth, death) for g in range(6)))
    assert list(two) == pytest.approx([sum(p[i] * p[g - i] for i in range(g + 1)) for g in range(6)])


def test_samplers(spark):
    rows = spark.range(3000).select("id", F.lit(4).alias("k"), F.lit(1000).alias("n"))
    got = P.sample_coal_times(rows, "k", "n", "id")
    means = {r.lineages: r.m for r in got.groupBy("lineages").agg(F.avg("t").alias("m")).collect()}
    assert means[4] == pytest.approx(1000 / 6, rel=0.1) and means[2] == pytest.approx(1000 / 6 + 1000 / 3 + 1000, rel=0.1)
    forest = P.sample_coal_trees(rows.limit(20), "k", "n", "id")
    assert trees.ages(forest).agg(F.max("spread")).first()[0] < 1e-6 and trees.leaves(forest).count() == 80
    s = P.sample_sequences(forest, 50)
    assert s.count() == 140 and s.where("seq rlike '^[ACGT]{50}$'").count() == 140


def test_substitution_matrix():
    t = 0.7
    m = np.array(P.substitution_matrix(t))
    assert m[0, 0] == pytest.approx(0.25 + 0.75 * math.exp(-4 * t / 3)) and m[0, 1] == pytest.approx(0.25 - 0.25 * math.exp(-4 * t / 3))
    f = (0.4, 0.1, 0.2, 0.3)
    m = np.array(P.substitution_matrix(t, f, 3.0))
    assert m.sum(1) == pytest.approx(np.ones(4)) and np.array(f) @ m == pytest.approx(np.array(f)) and m[0, 2] / f[2] > m[0, 3] / f[3]
    assert m @ m == pytest.approx(np.array(P.substitution_matrix(2 * t, f, 3.0)))


MODEL = hmm.Model([0.6, 0.4], [[0.7, 0.3], [0.4, 0.6]], [{"a": 0.5, "b": 0.5}, {"a": 0.1, "b": 0.9}])


def chance(path, symbols):
    p = MODEL.prior[path[0]]
    for i, (s, x) in enumerate(zip(path, symbols, strict=True)):
        p *= (MODEL.move[path[i - 1]][s] if i else 1) * MODEL.emit[s][x]
    return p


def test_hmm_against_all_paths(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(6):
        symbols = rng.choices("ab", k=rng.randrange(1, 7))
        rows += [(k, i, x) for i, x in enumerate(symbols)]
        paths = {p: chance(p, symbols) for p in itertools.product((0, 1), repeat=len(symbols))}
        total, best = sum(paths.values()), max(paths, key=paths.get)
        want[k] = (math.log(total), [(i, s, sum(v for p, v in paths.items() if p[i] == s) / total) for i, s in enumerate(best)])
        assert np.allclose(list(hmm.forward_steps(MODEL, symbols)), hmm.forward(MODEL, symbols))
        drawn = [tuple(hmm.sample_path(MODEL, symbols, np.random.default_rng(i))) for i in range(300)]
        assert sum(d == best for d in drawn) / 300 == pytest.approx(paths[best] / total, abs=0.1)
    df = spark.createDataFrame(rows, "k int, i int, x string")
    for r in hmm.likelihood(df, "k", ["i"], "x", MODEL).collect():
        assert r.lnl == pytest.approx(want[r.k][0])
    got = hmm.decode(df, "k", ["i"], "x", MODEL).orderBy("k", "i").collect()
    for k, (_, path) in want.items():
        assert [(r.i, r.state) for r in got if r.k == k] == [(i, s) for i, s, _ in path]
        assert [r.p for r in got if r.k == k] == pytest.approx([p for _, _, p in path])
    states, symbols = hmm.generate(MODEL, 20, np.random.default_rng(1))
    assert len(states) == len(symbols) == 20


@pytest.mark.parametrize("stretch", [1, 3, 7, 1000])
def test_hmm_in_stretches(spark, stretch):
    """A sequence over many stretches as the same one in memory; null and unknown symbols, a null key, an empty table."""
    rng = random.Random(stretch)
    model = hmm.Model([0.5, 0.2, 0.3], [[0.71, 0.19, 0.1], [0.13, 0.8, 0.07], [0.23, 0.17, 0.6]], [{"a": 0.53, "b": 0.47}, {"a": 0.11, "b": 0.89}, {"a": 0.7, "c": 0.3}])
    given = {"hot": 200, None: 31, "one": 1, "two": 2}
    symbols = {k: [rng.choice(["a", "b", "a", "b", None, "z"]) for _ in range(n)] for k, n in given.items()}
    rows = [(k, i, x, i) for k, line in symbols.items() for i, x in enumerate(line)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, x string, state int")
    got = hmm.decode(df, "k", ["i"], "x", model, stretch).orderBy("i")
    assert got.columns == ["k", "i", "state", "p"]
    for k, line in symbols.items():
        mine = [r for r in got.collect() if r.k == k]
        path = hmm.viterbi(model, line)
        assert [r.i for r in mine] == list(range(len(line))) and [r.state for r in mine] == path
        assert np.allclose([r.p for r in mine], hmm.posterior(model, line)[np.arange(len(line)), path])
    assert hmm.decode(df.where("false"), "k", ["i"], "x", model, stretch).count() == 0


def test_hmm_of_equal_ways(spark):
    """Where all ways are alike, stretches still give one of the likeliest paths, and impossible moves aren't taken."""
    model = hmm.Model([0.5, 0.5], [[0.0, 1.0], [1.0, 0.0]], [{"a": 0.5}, {"a": 0.5}])
    df = spark.range(23).selectExpr("id as i", "'a' as x", "1 as k")
    states = [r.state for r in hmm.decode(df, "k", ["i"], "x", model, 4).orderBy("i").collect()]
    assert all(a != b for a, b in zip(states, states[1:], strict=False))


def test_a_long_sequence_spans_tasks(spark):
    n = 60_000
    df = spark.range(n).selectExpr("0 as k", "id as i", "case when pmod(xxhash64(id), 100) < 30 + 40 * (id div 1000 % 2) then 'a' else 'b' end as x")
    model = hmm.Model([0.5, 0.5], [[0.999, 0.001], [0.0015, 0.9985]], [{"a": 0.3, "b": 0.7}, {"a": 0.71, "b": 0.29}])
    got = hmm.decode(df, "k", ["i"], "x", model)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan
    line = got.orderBy("i").toPandas()
    symbols = [r.x for r in df.orderBy("i").collect()]
    assert len(line) == n and line.state.tolist() == hmm.viterbi(model, symbols)
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_codons(spark):
    s = F.lit("ATGAAANNNgga---TAA")
    assert one(spark, align.translate(s))[0] == "MKXG-*"
    assert one(spark, align.translate(F.lit("")))[0] == ""
    assert one(spark, align.back_translate(F.lit("M-K"), F.lit("ATGAAA")))[0] == "ATG---AAA"
    assert one(spark, align.stops_masked(F.lit("ATGTAAATAATG")))[0] == "ATGNNNATAATG"
    with pytest.raises(Exception, match="multiple of three"):
        one(spark, align.translate(F.lit("ATGA")))


def test_alignment_columns(spark):
    a = aln(spark, "AC--GT", "A---GA", "AC--G-")
    assert seqs(align.without_empty(a)) == ["ACGT", "A-GA", "ACG-"]
    assert seqs(align.without_gaps(a)) == ["AG", "AG", "AG"]
    assert seqs(align.require(a, 2)) == ["ACGT", "A-GA", "ACG-"]
    assert seqs(align.without_empty(aln(spark, "---ATG", "---A--"), by_codon=True)) == ["ATG", "A--"]
    assert [(round(r.share, 3), r.mark) for r in align.conservation(a).orderBy("pos").collect()] == [(1.0, "*"), (0.667, "."), (0.0, " "), (0.0, " "), (1.0, "*"), (0.333, " ")]
    r = one(spark, align.overlap(F.lit("AC-G"), F.lit("A-CG")), align.local_to_align(F.lit("AT--G")), align.align_to_local(F.lit("-AT--G")))
    assert r[0] == 2 and r[1] == [0, 1, 4] and r[2] == [-1, 0, 1, 1, 1, 2]
    score = align.pssm_scores(align.pssm(aln(spark, "AC", "AG")), aln(spark, "AC"))
    assert score.first()["score"] == pytest.approx(-1)
    assert seqs(align.sampled_columns(aln(spark, "ACGT", "ACGT"), 5))[0] == seqs(align.sampled_columns(aln(spark, "ACGT", "ACGT"), 5))[1]
    two = aln(spark, "AC", "GG").union(spark.createDataFrame([("y", "s0", "TTT")], "a string, b string, c string"))
    assert {r.name: r.seq for r in align.concatenated(two).collect()} == {"s0": "ACTTT", "s1": "GGNNN"}


def test_four_fold(spark):
    a = aln(spark, "GGAATGGC--CT", "GGTATGGCTCCC")
    assert seqs(align.aligned_codons(a)) == ["GGAATG", "GGTATG"]
    assert seqs(align.four_fold(a)) == ["A", "T"]
    assert sorted(x for x, _ in align.FOUR_FOLD) == sorted("LPRSTVAG")
