"""Coalescent and birth-death probabilities as columns, and seeded samplers.

Times are in generations, n is the population size in gene copies. Sums over
lineages run inside the JVM; the samplers draw from the row's own seed, so a
rerun of a lost task gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .special import choose, lit, log_factorial, log_gamma

LONG = "long"


def _sum(low: Column, high: Column, f) -> Column:
    """The sum of f(i) for i from low to high; 0 where there is none."""
    steps = F.when(low <= high, F.sequence(low.cast(LONG), high.cast(LONG))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.lit(0.0), lambda s, i: s + f(i))


def _rate(k: Column, n) -> Column:
    return k * (k - 1) / 2 / lit(n)


def prob_coal(t: Column, k: Column, n) -> Column:
    """Density of the first meeting of k lineages at t."""
    return _rate(k, n) * F.exp(-_rate(k, n) * t)


def prob_coal_counts(a: Column, b: Column, t: Column, n) -> Column:
    """The chance that a lineages have b ancestors after t.

    The terms alternate in sign; their sizes go by log factorials. Their
    cancellation leaves about 10 digits at 10 lineages and 6 at 20.
    """

    def term(k):
        size = log_gamma(b + k - 1) - log_gamma(b) + log_gamma(a) + log_gamma(a + 1) - log_gamma(a - k + 1) - log_gamma(a + k)
        # the rising product of b holds for k factors; (k + b - 1) divides it again
        size = size - log_factorial(b) - log_factorial(k - b) + F.log(2 * k - 1.0)
        return F.when((k - b) % 2 == 0, 1.0).otherwise(-1.0) * F.exp(size - _rate(k, n) * t)

    return F.when((b <= 0) | (b > a), 0.0).otherwise(_sum(b, a, term))


def prob_coal_cond_counts(x: Column, a: Column, b: Column, t: Column, n) -> Column:
    """Density of the first meeting of a lineages at x, given that b are left at t."""
    return prob_coal(x, a, n) * prob_coal_counts(a - 1, b, t - x, n) / prob_coal_counts(a, b, t, n)


def cdf_mrca(t: Column, k: Column, n) -> Column:
    """The chance that k lineages have one ancestor by t."""
    return F.when(k == 1, 1.0).otherwise(prob_coal_counts(k, F.lit(1) + k * 0, t, n))


def prob_mrca(t: Column, k: Column, n) -> Column:
    """Density of the age of the common ancestor: the rate of the last two lineages times their chance."""
    return prob_coal_counts(k, F.lit(2) + k * 0, t, n) / lit(n)


def prob_bounded_coal(t: Column, k: Column, n, bound: Column) -> Column:
    """prob_coal, given that all k meet before the bound."""
    return F.when(t > bound, 0.0).otherwise(prob_coal(t, k, n) * cdf_mrca(bound - t, k - 1, n) / cdf_mrca(bound, k, n))


def cdf_bounded_coal(t: Column, k: Column, n, bound: Column) -> Column:
    """The chance that the first of k lineages meet by t, given that all k meet before the bound: what is left of none meeting and all doing so in the rest."""
    rest = F.exp(-_rate(k, n) * t) * cdf_mrca(bound - t, k, n) / cdf_mrca(bound, k, n)
    return F.when(t >= bound, 1.0).otherwise(1 - rest)


def cdf_coal_cond_counts(x: Column, a: Column, b: Column, t: Column, n) -> Column:
    """The chance of a first meeting of a lineages by x, given that b are left at t."""
    return 1 - F.exp(-_rate(a, n) * x) * prob_coal_counts(a, b, t - x, n) / prob_coal_counts(a, b, t, n)


def log_labelled_histories(leaves: Column, roots: Column) -> Column:
    """ln of the number of orders in which `leaves` lineages can meet down to `roots`."""
    return _sum(roots + 1, leaves, lambda k: F.log(k * (k - 1) / 2.0))


def popsize_of_times(times: DataFrame, by: list[str], rank: str = "k", time: str = "t") -> DataFrame:
    """(by, n): the likeliest population size of the meeting times t of k, k - 1, ..., 2 lineages.

    The time spent with k lineages counts k (k - 1) / 2 times.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.desc(rank))
    wait = F.col(time) - F.coalesce(F.lag(time).over(w), F.lit(0.0))
    return times.withColumn("_w", wait * F.col(rank) * (F.col(rank) - 1) / 2).groupBy(*by).agg((F.sum("_w") / F.count("*")).alias("n"))


def prob_birth_death1(genes: Column, t: Column, birth: float, death: float) -> Column:
    """The chance that one lineage has so many descendants after t."""
    if birth == death:
        u = t * birth / (1 + t * birth)
        none = u
    else:
        e = F.exp(-(birth - death) * t)
        u = (1 - e) * birth / (birth - death * e)
        none = u * (death / birth) if birth else 1 - F.exp(-death * t)
    return F.when(genes == 0, none).otherwise((1 - none) * (1 - u) * F.pow(u, (genes - 1).cast("double")))


def prob_birth_death(start: Column, end: Column, t: Column, birth: float, death: float) -> Column:
    """The chance that `start` lineages have `end` descendants after t.

    Of the lineages j survive, each with a chance of 1 - p0, and the others'
    places are filled by geometric numbers of descendants.
    """
    p0 = prob_birth_death1(F.lit(0) + start * 0, t, birth, death)
    p1 = prob_birth_death1(F.lit(1) + start * 0, t, birth, death)
    u = 1 - p1 / (1 - p0)
    body = _sum(F.lit(1) + start * 0, F.least(start, end), lambda j: choose(start, j) * choose(end - 1, j - 1) * F.pow(p0, (start - j).cast("double")) * F.pow(p1, j.cast("double")) * F.pow(u, (end - j).cast("double")))
    return F.when(start < 1, 0.0).when(end == 0, F.pow(p0, start.cast("double"))).otherwise(body)


def prob_no_birth(n: Column, t: Column, birth: float, death: float) -> Column:
    """The chance that none of n lineages splits into two that both live after t."""
    if birth == 0:
        return F.lit(1.0) + t * 0
    if birth == death:
        return F.pow(1 + birth * t, -n.cast("double"))
    e = F.exp(-(birth - death) * t)
    return F.pow(1 - birth * (1 - e) / (birth - death * e), n.cast("double"))


def birth_wait_time(t: Column, n: Column, until: Column, birth: float, death: float) -> Column:
    """Density of the first birth at t of n lineages whose offspring live at `until`.

    None of the n, kept alive or not, may split before: the chance of none in
    `until`, undone for the time that is left, times n births at t whose two sides both last.
    """
    left = until - t
    if birth == death:
        last = 1 / (1 + birth * left)
    else:
        last = (birth - death) / (birth - death * F.exp(-(birth - death) * left))
    none = prob_no_birth(n, until, birth, death) / prob_no_birth(n, left, birth, death)
    return n * birth * last * none


def substitution_matrix(t: float, freqs=(0.25, 0.25, 0.25, 0.25), kappa: float = 1.0) -> list[list[float]]:
    """Chances of change between A, C, G and T over a branch of t expected changes a site.

    Changes within purines and within pyrimidines are kappa times as frequent
    as others; equal frequencies and kappa 1 treat all changes alike.
    """
    import numpy as np

    f = np.asarray(freqs, float)
    near = np.array([[0, 0, 1, 0], [0, 0, 0, 1], [1, 0, 0, 0], [0, 1, 0, 0]])
    q = np.where(near == 1, kappa, 1.0) * f
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(1))
    q /= -(f * np.diag(q)).sum()
    root = np.sqrt(f)
    w, v = np.linalg.eigh(root[:, None] * q / root)  # similar to a symmetric matrix
    return ((v * np.exp(w * t)) @ v.T / root[:, None] * root).tolist()


def sample_coal_times(rows: DataFrame, k: str, n: str, seed: str) -> DataFrame:
    """For every row k - 1 rows (lineages, t): when its lineages meet. `seed` is a column of integers."""
    cols = rows.columns
    steps = rows.where(F.col(k) > 1).withColumn("lineages", F.explode(F.sequence(F.col(k).cast("int"), F.lit(2), F.lit(-1))))
    # a uniform number of the seed and the step, so that any task gives the same
    u = (F.xxhash64(F.col(seed), F.col("lineages")).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    steps = steps.withColumn("_w", -F.log(u) / _rate(F.col("lineages"), F.col(n).cast("double")))
    from pyspark.sql import Window

    w = Window.partitionBy(*cols).orderBy(F.desc("lineages")).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("t", F.sum("_w").over(w)).drop("_w")


def sample_coal_trees(rows: DataFrame, k: str, n: str, seed: str) -> DataFrame:
    """A random tree of k leaves for every row, as (tree_id, node, parent, dist); tree_id is the seed."""
    import pandas as pd

    def run(batches):
        import random

        for pdf in batches:
            out = []
            for kk, nn, s in zip(pdf["k"], pdf["n"], pdf["seed"], strict=True):
                rng, live, t = random.Random(int(s)), [(f"l{i}", 0.0) for i in range(int(kk))], 0.0
                for new in range(1, int(kk)):
                    m = len(live)
                    t += rng.expovariate(m * (m - 1) / 2 / nn)
                    for _ in range(2):
                        name, born = live.pop(rng.randrange(len(live)))
                        out.append((str(s), name, f"i{new}", t - born))
                    live.append((f"i{new}", t))
                out.extend((str(s), name, None, None) for name, _ in live)
            yield pd.DataFrame(out, columns=["tree_id", "node", "parent", "dist"])

    got = rows.select(F.col(k).cast("int").alias("k"), F.col(n).cast("double").alias("n"), F.col(seed).cast(LONG).alias("seed"))
    return got.mapInPandas(run, "tree_id string, node string, parent string, dist double")


def sample_sequences(nodes: DataFrame, length: int, freqs=(0.25, 0.25, 0.25, 0.25), kappa: float = 1.0, seed: int = 0) -> DataFrame:
    """(tree_id, node, seq): sequences evolved down every tree. A tree must fit in a task."""
    import pandas as pd

    def run(pdf):
        import zlib

        import numpy as np

        from ..operators.trees import Tree, _clean

        t = Tree(_clean(pdf))
        rng = np.random.default_rng([seed, zlib.crc32(str(pdf["tree_id"].iloc[0]).encode())])
        seqs: dict = {}
        for node in t.preorder():
            if node == t.root:
                seqs[node] = rng.choice(4, length, p=freqs)
                continue
            chance = np.cumsum(substitution_matrix(t.dist[node], freqs, kappa), 1)
            seqs[node] = np.minimum((rng.random(length)[:, None] > chance[seqs[t.parent[node]]]).sum(1), 3)
        letters = np.array(list("ACGT"))
        return pd.DataFrame([(pdf["tree_id"].iloc[0], x, "".join(letters[s])) for x, s in seqs.items()], columns=["tree_id", "node", "seq"])

    from ..operators.trees import _as_text

    return _as_text(nodes).groupBy("tree_id").applyInPandas(run, "tree_id string, node string, seq string")


def prob_fixation(p: Column, n: Column, t: Column, terms: int = 50) -> Column:
    """The chance that an allele of frequency p is fixed by t under drift alone.

    Kimura's series over Legendre polynomials of r = 1 - 2 p.
    """
    p = p.cast("double")

    def step(s, i):
        after = ((2 * i + 1) * (1 - 2 * p) * s["now"] - i * s["before"]) / (i + 1)
        sign = F.when(i % 2 == 0, 0.5).otherwise(-0.5)
        return F.struct(s["now"].alias("before"), after.alias("now"), (s["sum"] + sign * (s["before"] - after) * F.exp(-t * i * (i + 1) / (4.0 * n))).alias("sum"))

    zero = F.struct(F.lit(1.0).alias("before"), (1 - 2 * p).alias("now"), p.alias("sum"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), zero, step, lambda s: s["sum"])


def num_rooted_trees(leaves: int) -> int:
    """Binary rooted trees over labelled leaves: 1 x 3 x 5 x ..."""
    return math.prod(range(1, 2 * leaves - 2, 2))


def num_unrooted_trees(leaves: int) -> int:
    return math.prod(range(1, 2 * leaves - 4, 2))
