"""Histograms, moments, regression, entropy and contingency tables; one pass of partial aggregates each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranged


def bins(df: DataFrame, value: str, n: int = 20, low: float | None = None, width: float | None = None) -> DataFrame:
    """Adds `bin`: min(int((x - low) / width), n - 1); low and width from the data at default. The limits are one row."""
    lim = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    lo = F.lit(float(low)) if low is not None else F.col("_lo")
    lim = lim.select(lo.alias("_lo"), (F.lit(float(width)) if width else (F.col("_hi") - lo) / n).alias("_w"))
    at = F.floor((F.col(value) - F.col("_lo")) / F.col("_w"))
    return df.join(F.broadcast(lim)).withColumn("bin", F.least(F.lit(n - 1).cast("long"), F.coalesce(F.when(F.col("_w") > 0, at), F.lit(0))))


def histogram(df: DataFrame, value: str, n: int = 20, **limits) -> DataFrame:
    out = bins(df, value, n, **limits)
    return out.groupBy("bin").agg(F.first(F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"), F.count("*").alias("n"))


def histogram2(df: DataFrame, x: str, y: str, n: int = 10) -> DataFrame:
    both = bins(bins(df, x, n).withColumnRenamed("bin", "bin_x").drop("_lo", "_w"), y, n).withColumnRenamed("bin", "bin_y")
    return both.groupBy("bin_x", "bin_y").agg(F.count("*").alias("n"))


def fit_line(x: str, y: str) -> list[Column]:
    """Slope, intercept and r2 as aggregates; null where x is constant."""
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")]


def correlation(x: str, y: str) -> Column:
    """Pearson's r; infinity where a variance is 0."""
    return F.coalesce(F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)), F.lit(float("inf")))


def entropy(counts: DataFrame, n: str, by: list[str]) -> DataFrame:
    """Base-2 entropy of the shares of positive counts."""
    w = Window.partitionBy(*by)
    p = F.col(n) / F.sum(n).over(w)
    return counts.withColumn("_p", p).where("_p > 0").groupBy(*by).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"))


def chi_square(counts: DataFrame, row: str, col: str, n: str) -> DataFrame:
    """Statistic and degrees of freedom of a contingency table given as cells; absent cells count 0."""
    rows, cols = counts.groupBy(row).agg(F.sum(n).alias("_r")), counts.groupBy(col).agg(F.sum(n).alias("_c"))
    total = counts.agg(F.sum(n).alias("_t"), F.count_distinct(row).alias("_nr"), F.count_distinct(col).alias("_nc"))
    # sum over cells of n^2 / expected, minus the total: absent cells add nothing
    x = counts.join(rows, row).join(cols, col).agg(F.sum(F.col(n) * F.col(n) / (F.col("_r") * F.col("_c"))).alias("_s"))
    return x.join(F.broadcast(total)).select((F.col("_t") * (F.col("_s") - 1)).alias("chi2"), ((F.col("_nr") - 1) * (F.col("_nc") - 1)).alias("df"))


def z_scores(df: DataFrame, by: list[str], value: str) -> DataFrame:
    m = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.join(m, by).withColumn("z", (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def dense_counts(df: DataFrame, value: str, top: int) -> DataFrame:
    """(value, n) for every integer from 0 to top, 0 where absent; negatives and larger values are left out."""
    all_ = df.sparkSession.range(top + 1).select(F.col("id").alias(value))
    return all_.join(df.groupBy(F.col(value).cast("long").alias(value)).agg(F.count("*").alias("_n")), value, "left").select(value, F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def one_norm(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Each value's share of its group's sum."""
    total = df.groupBy(*by).agg(F.sum(value).alias("_t"))
    return df.join(total, by).withColumn(out, F.try_divide(F.col(value), F.col("_t"))).drop("_t")


def log_sum(df: DataFrame, by: list[str], value: str, out: str, within: float | None = None) -> DataFrame:
    """ln(sum(exp(x))) of each group, by two passes of partial sums; `within` leaves out the terms that far below the largest."""
    top = df.groupBy(*by).agg(F.max(value).alias("_m"))
    near = df.join(top, by)
    near = near.where(F.col(value) >= F.col("_m") - within) if within is not None else near
    return near.groupBy(*by, "_m").agg(F.sum(F.exp(F.col(value) - F.col("_m"))).alias("_s")).select(*by, (F.col("_m") + F.ln("_s")).alias(out))


def error(a: str, b: str) -> Column:
    """Mean squared difference as an aggregate."""
    return F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))


def q_values(df: DataFrame, by: list[str], p: str, out: str = "q") -> DataFrame:
    """The smallest share of false finds at which each p would be accepted (Benjamini and Hochberg).

    Equal values are ranked once, so a window holds distinct ones only.
    """
    n = df.groupBy(*by, p).agg(F.count("*").alias("_k"))
    if by:
        w = Window.partitionBy(*by)
        n = n.withColumn("_q", F.col(p) * F.sum("_k").over(w) / F.sum("_k").over(w.orderBy(p).rowsBetween(Window.unboundedPreceding, 0)))
        n = n.withColumn("_q", F.min("_q").over(w.orderBy(p).rowsBetween(0, Window.unboundedFollowing)))
    else:  # in ranges, of which only the sums and least values meet in one task
        n = ranged(n, [p])
        part, parts = Window.partitionBy("_part"), Window.orderBy("_part")
        sums = n.groupBy("_part").agg(F.sum("_k").alias("_s"))
        sums = sums.select("_part", F.coalesce(F.sum("_s").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_s").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
        rank = F.col("_before") + F.sum("_k").over(part.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
        n = n.join(F.broadcast(sums), "_part").withColumn("_q", F.col(p) * F.col("_all") / rank)
        later = n.groupBy("_part").agg(F.min("_q").alias("_l")).select("_part", F.min("_l").over(parts.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
        here = F.min("_q").over(part.orderBy("_at").rowsBetween(0, Window.unboundedFollowing))
        n = n.join(F.broadcast(later), "_part").withColumn("_q", F.least(here, "_later"))
    return df.join(n.select(*by, p, F.least("_q", F.lit(1.0)).alias(out)), [*by, p])


def enrich(inside: DataFrame, outside: DataFrame, item: str) -> DataFrame:
    """(item, n_in, n_out, p, q): how surprising the number of each item among the inside rows is, by the hypergeometric tail."""
    from ..functions.special import hypergeometric_tail

    both = inside.select(item, F.lit(1).alias("x")).union(outside.select(item, F.lit(0)))
    each = both.groupBy(item).agg(F.sum("x").alias("n_in"), F.count_if(F.col("x") == 0).alias("n_out"))
    tot = each.agg(F.sum("n_in").alias("_a"), F.sum("n_out").alias("_b"))  # one row
    p = hypergeometric_tail(F.col("n_in"), F.col("_a"), F.col("n_in") + F.col("n_out"), F.col("_a") + F.col("_b"))
    return q_values(each.join(F.broadcast(tot)).select(item, "n_in", "n_out", p.alias("p")), [], "p")


def divergence(counts: DataFrame, p: str, q: str, by: list[str]) -> DataFrame:
    """(by, cross_entropy, kl) in bits, of the shares that rows have of the sums of p and q.

    Rows without p count nothing; one with p but without q makes both infinite.
    """
    w = Window.partitionBy(*by)
    x = F.try_divide(F.col(p), F.sum(p).over(w)).cast("double")
    y = F.try_divide(F.col(q), F.sum(q).over(w)).cast("double")
    rows = counts.select(*by, x.alias("_x"), y.alias("_y")).where("_x > 0")
    bits = F.when(F.col("_y") > 0, -F.log2("_y")).otherwise(F.lit(float("inf")))
    return rows.groupBy(*by).agg(F.sum(F.col("_x") * bits).alias("cross_entropy"), F.sum(F.col("_x") * (bits + F.log2("_x"))).alias("kl"))


def rank_of(df: DataFrame, by: list[str], value: str, x: float) -> DataFrame:
    """(by, rank, share): how many values are at most x, and their share of one more than all."""
    n = F.count_if(F.col(value) <= x)
    return df.groupBy(*by).agg(n.alias("rank"), (n / (F.count(value) + 1)).alias("share"))


def pair_matrix(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, x, y, cov, r) of every two of the columns, x and y in both orders: sample covariance and correlation() in one pass."""
    pairs = [(x, y) for x in columns for y in columns]
    aggs = [f(x, y).alias(f"{k}{i}") for i, (x, y) in enumerate(pairs) for k, f in (("c", F.covar_samp), ("r", correlation))]
    rows = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"c{i}").alias("cov"), F.col(f"r{i}").alias("r")) for i, (x, y) in enumerate(pairs)))
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(rows))


def modes(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, mode, n): the commonest value of each group; of equals the smallest."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    return n.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("k"), F.col(value).alias("v"))).alias("_m")).select(*by, F.col("_m.v").alias("mode"), (-F.col("_m.k")).alias("n"))


def products(value: str) -> list[Column]:
    """prod and log_prod of values above 0, as aggregates."""
    log = F.sum(F.ln(value))
    return [F.product(value).alias("prod"), log.alias("log_prod")]


def correlation_p(r: Column, n: Column) -> Column:
    """The chance of a correlation above r in n samples, by Student's t: half an incomplete beta function."""
    from ..functions.special import beta_share

    df = n.cast("double") - 2
    tail = 0.5 * beta_share(df / 2, F.lit(0.5), 1 - r * r)
    return F.when(r >= 0, tail).otherwise(1 - tail)


def _equal_bins(df: DataFrame, value: str, divisions: int, least: int) -> tuple[DataFrame | None, int]:
    """(bin, n, low) of bins of n // divisions rows in order of value, or of n // (n // least) where that is under least; and n."""
    from .ordered import numbered

    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    n = rows.count()
    if n == 0:
        return None, 0
    size = n // divisions
    size = size if size >= least else n // max(1, n // least)
    return numbered(rows, ["v"], "_i").groupBy(F.floor(F.col("_i") / size).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low")), n


def goodness_of_fit(df: DataFrame, value: str, cdf, divisions: int = 20, least: int = 5) -> DataFrame:
    """(chi2, df): observed against expected numbers in bins of equal counts, cdf being a function of a column.

    A bin has n // divisions rows in order of value, or where that is under `least`
    n // (n // least) of them; the last bin has the rest. A bin reaches from its first value to the next bin's, the
    first and the last bin to the ends.
    """
    bins, n = _equal_bins(df, value, divisions, least)
    if bins is None:
        return df.sparkSession.range(0).select(F.lit(0.0).alias("chi2"), F.lit(0).cast("long").alias("df"))
    w = Window.orderBy("bin")  # about `divisions` rows
    high = F.lead("low").over(w)
    low = F.when(F.lag("low").over(w).isNull(), F.lit(0.0)).otherwise(cdf(F.col("low")))
    bins = bins.withColumn("expected", n * (F.coalesce(cdf(high), F.lit(1.0)) - low))
    return bins.agg(F.sum((F.col("n") - F.col("expected")) * (F.col("n") - F.col("expected")) / F.col("expected")).alias("chi2"), (F.count("*") - 1).alias("df"))


def fit_distribution(df: DataFrame, value: str, cdf, start: list[float], divisions: int = 20, least: int = 5) -> tuple[list[float], float]:
    """The parameters that make chi-square least over the bins of goodness_of_fit(), and that chi-square.

    cdf is a function of a number and the parameters. Only the bins, about
    `divisions`, come to the driver, where a simplex walks; so the parameters
    are those of a low point, not of the lowest for sure.
    """
    bins, n = _equal_bins(df, value, divisions, least)
    if bins is None:
        raise ValueError("no values to fit")
    got = bins.orderBy("bin").collect()

    def chi2(params) -> float:
        at = [0.0, *(cdf(r.low, params) for r in got[1:]), 1.0]
        want = [n * (b - a) for a, b in zip(at, at[1:], strict=False)]
        return sum((r.n - w) ** 2 / w for r, w in zip(got, want, strict=True)) if all(w > 0 for w in want) else float("inf")

    return _least(chi2, start)


def _least(f, start: list[float], rounds: int = 2000) -> tuple[list[float], float]:
    """A low point of f and its value there, by a simplex that is mirrored, stretched or drawn in."""
    import numpy as np

    corners = [np.array(start, float)]
    for i, x in enumerate(start):
        c = corners[0].copy()
        c[i] = x * 1.1 if x else 0.1
        corners.append(c)
    ranked = sorted(((f(c), i, c) for i, c in enumerate(corners)), key=lambda v: v[:2])
    for turn in range(len(corners), rounds):
        best, worst = ranked[0], ranked[-1]
        if worst[0] - best[0] <= 1e-12 * (1 + abs(best[0])):
            break
        mid = np.mean([c for _, _, c in ranked[:-1]], axis=0)
        tries = [mid + k * (mid - worst[2]) for k in (1.0, 2.0, 0.5, -0.5)]
        there = f(tries[0])
        if there < best[0]:
            more = f(tries[1])
            new = (more, turn, tries[1]) if more < there else (there, turn, tries[0])
        elif there < ranked[-2][0]:
            new = (there, turn, tries[0])
        else:
            c = tries[2] if there < worst[0] else tries[3]
            new = (f(c), turn, c)
            if new[0] >= min(there, worst[0]):
                ranked = sorted([best, *((f(c), i, c) for _, i, c in ((v, i, best[2] + (c - best[2]) / 2) for v, i, c in ranked[1:]))], key=lambda v: v[:2])
                continue
        ranked = sorted([*ranked[:-1], new], key=lambda v: v[:2])
    return [float(x) for x in ranked[0][2]], float(ranked[0][0])


def fit_curve(df: DataFrame, x: str, y: str, f, start: list[float], rounds: int = 100, settled: float = 1e-12) -> tuple[list[float], float]:
    """The parameters that make the squared errors of y against f(x, parameters) least, and their sum.

    f makes a column of a column and a list of numbers. A round is one
    aggregate over all rows: slopes by small steps of each parameter, their
    products and the errors' sum; the driver sees (k + 1)(k + 2) / 2 sums and
    takes a damped step. Rows with a null are left out.
    """
    import numpy as np

    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    k = len(start)

    def sums(p):
        def bent(i, h):
            return f(F.col("x"), [float(v + (h if j == i else 0.0)) for j, v in enumerate(p)])

        steps = [max(abs(v), 1e-3) * 1e-6 for v in p]
        slopes = {f"s{i}": (bent(i, h) - bent(i, -h)) / (2 * h) for i, h in enumerate(steps)}
        with_ = rows.select(*(c.alias(n) for n, c in slopes.items()), (F.col("y") - f(F.col("x"), [float(v) for v in p])).alias("e"))
        names = [*slopes, "e"]
        r = with_.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for i, a in enumerate(names) for b in names[i:])).first()
        m = np.zeros((k + 1, k + 1))
        m[np.triu_indices(k + 1)] = [np.nan if v is None else v for v in r]
        m += np.triu(m, 1).T
        return m[:k, :k], m[:k, k], m[k, k]

    p = np.array(start, float)
    curve, pull, error = sums(p)
    if np.isnan(error):
        raise ValueError("no rows to fit, or no number at the start")
    damp = 1e-3
    for _ in range(rounds):
        size = np.diag(np.where(np.diag(curve) > 0, np.diag(curve), 1.0))
        step = np.linalg.solve(curve + damp * size, pull)
        c, g, e = sums(p + step)
        if e <= error:
            done = error - e <= settled * error or np.abs(step).max() <= settled * (1 + np.abs(p).max())
            p, curve, pull, error, damp = p + step, c, g, e, damp / 10
            if done:
                break
        elif damp > 1e12:
            break
        else:
            damp *= 10
    return [float(v) for v in p], float(error)


def fit_density(df: DataFrame, value: str, f, start: list[float], low: float, high: float, step: float, share: float = 1.0) -> tuple[list[float], float]:
    """fit_curve() of f to the density of the values from low to high in bins of width step, at the bins' middles.

    The density is a bin's share of all values in low to high, over step and `share`.
    """
    at = F.floor((F.col(value) - low) / step)
    inside = df.where((F.col(value) >= low) & (F.col(value) < high))
    n = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    bins = int(-(-(high - low) // step))
    full = df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(n, "bin", "left").fillna(0, "n")
    all_ = full.agg(F.sum("n").alias("all"))
    dense = full.join(F.broadcast(all_)).select((low + (F.col("bin") + 0.5) * step).alias("x"), (F.col("n") / F.col("all") / step / share).alias("y"))
    return fit_curve(dense, "x", "y", f, start)


def weighted_pick(choices: DataFrame, item: str, weight: str, u: Column, rows: DataFrame) -> DataFrame:
    """Adds `item` to rows: that whose stretch of the cumulative weights, in order of item, holds u (0..1). Choices are few and broadcast.

    u looks only through the stretches that end in its cell of 1/1,024, or takes the first that ends later; beyond all it takes the last.
    """
    w = Window.orderBy(item)
    if choices.limit(100_001).count() > 100_000:
        raise ValueError("more than 100,000 choices")
    part = choices.where(F.col(weight) > 0).select(F.col(item).alias("_item"), F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_hi"), F.sum(weight).over(Window.partitionBy()).alias("_all"))
    ends = part.select((F.col("_hi") / F.col("_all")).alias("_h"), "_item")
    cell = lambda c: F.when(F.col(c) < 0, 0).when(F.col(c) < 1, F.floor(F.col(c) * 1024)).otherwise(1023).cast("int")
    # the first end of a later cell, and the last of all: one row each
    cells = ends.withColumn("_c", cell("_h")).groupBy("_c").agg(F.sort_array(F.collect_list(F.struct("_h", "_item"))).alias("_t"))
    last = F.max("_t").over(Window.partitionBy())
    after = F.first(F.get("_t", F.lit(0)), ignorenulls=True).over(Window.orderBy("_c").rowsBetween(1, Window.unboundedFollowing))
    every = choices.sparkSession.range(1024).select(F.col("id").cast("int").alias("_c")).join(cells, "_c", "left").select("_c", "_t", after.alias("_after"), F.element_at(last, -1)["_item"].alias("_end"))
    held = F.get(F.filter("_t", lambda x: x["_h"] > F.col("_u")), F.lit(0))["_item"]
    at = rows.withColumn("_u", u).withColumn("_c", cell("_u")).join(F.broadcast(every), "_c")
    return at.withColumn(item, F.coalesce(held, F.col("_after")["_item"], "_end")).drop("_c", "_u", "_t", "_after", "_end")
