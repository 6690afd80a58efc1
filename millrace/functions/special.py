"""Special functions, densities and distribution functions as columns.

All are expressions of the JVM but gamma_inc and erf, whose series run in
Arrow batches. Log factorials go by Lanczos' sum, good to 13 digits.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos' coefficients for g = 7, n = 9.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0."""
    z = x.cast("double") - 1.0
    s = reduce(lambda a, b: a + b, (F.lit(c) / (z + float(i)) for i, c in enumerate(LANCZOS) if i), F.lit(LANCZOS[0]))
    w = z + 7.5
    return (z + 0.5) * F.log(w) - w + F.log(s) + F.lit(0.5 * math.log(2 * math.pi))


def log_factorial(x: Column, down_to: Column | int = 1) -> Column:
    """ln of x! / k!."""
    whole = log_gamma(x + 1)
    return whole if isinstance(down_to, int) and down_to <= 1 else whole - log_gamma(lit(down_to) + 1)


def log_choose(n: Column, k: Column) -> Column:
    """ln of n over k; minus infinity where k is out of range."""
    inside = (k >= 0) & (k <= n)
    return F.when(inside, log_gamma(F.greatest(n, F.lit(0)) + 1) - log_gamma(F.greatest(k, F.lit(0)) + 1) - log_gamma(F.greatest(n - k, F.lit(0)) + 1)).otherwise(F.lit(float("-inf")))


def choose(n: Column, k: Column) -> Column:
    return F.exp(log_choose(n, k))


def log_multinomial(counts: Column) -> Column:
    """ln of the number of orders of an array's counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return log_gamma(total + 1) - F.aggregate(counts, F.lit(0.0), lambda a, x: a + log_gamma(x + 1))


def log_add(a: Column, b: Column) -> Column:
    """ln(e^a + e^b)."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    return F.when(lo == float("-inf"), hi).otherwise(hi + F.log1p(F.exp(lo - hi)))


def log_sub(a: Column, b: Column) -> Column:
    """ln(e^a - e^b) for a >= b."""
    return F.when(b == float("-inf"), a).when(a == b, F.lit(float("-inf"))).otherwise(a + F.log1p(-F.exp(b - a)))


def uniform_pdf(x: Column, a, b) -> Column:
    a, b = lit(a), lit(b)
    return F.when((x >= a) & (x <= b), 1 / (b - a)).otherwise(0.0)


def normal_pdf(x: Column, mu, sigma) -> Column:
    z = (x - lit(mu)) / lit(sigma)
    return F.exp(-z * z / 2) / (lit(sigma) * math.sqrt(2 * math.pi))


def normal_cdf(x: Column, mu, sigma) -> Column:
    return (1 + erf((x - lit(mu)) / (lit(sigma) * math.sqrt(2)))) / 2


def log_normal_pdf(x: Column, mu, sigma) -> Column:
    return F.when(x > 0, normal_pdf(F.log(x), mu, sigma) / x).otherwise(0.0)


def log_normal_cdf(x: Column, mu, sigma) -> Column:
    return F.when(x > 0, normal_cdf(F.log(F.greatest(x, F.lit(5e-324))), mu, sigma)).otherwise(0.0)


def poisson_pdf(k: Column, mean) -> Column:
    return F.exp(k * F.log(lit(mean)) - lit(mean) - log_gamma(k + 1))


def poisson_cdf(k: Column, mean) -> Column:
    return 1 - gamma_inc(F.floor(k) + 1, lit(mean))


def binomial_pdf(k: Column, n, p) -> Column:
    return F.exp(log_choose(lit(n), k) + k * F.log(lit(p)) + (lit(n) - k) * F.log1p(-lit(p)))


def neg_binomial_pdf(k: Column, r, p) -> Column:
    return F.exp(log_gamma(lit(r) + k) - log_gamma(k + 1) - log_gamma(lit(r)) + lit(r) * F.log(lit(p)) + k * F.log1p(-lit(p)))


def exponential_pdf(x: Column, rate) -> Column:
    return F.when(x < 0, 0.0).otherwise(lit(rate) * F.exp(-lit(rate) * x))


def exponential_cdf(x: Column, rate) -> Column:
    return F.when(x < 0, 0.0).otherwise(-F.expm1(-lit(rate) * x))


def log_gamma_pdf(x: Column, shape, rate) -> Column:
    a, b = lit(shape), lit(rate)
    return F.when(x > 0, a * F.log(b) + (a - 1) * F.log(x) - b * x - log_gamma(a)).otherwise(F.lit(float("-inf")))


def gamma_pdf(x: Column, shape, rate) -> Column:
    return F.exp(log_gamma_pdf(x, shape, rate))


def gamma_cdf(x: Column, shape, rate) -> Column:
    return gamma_inc(lit(shape), F.greatest(x, F.lit(0.0)) * lit(rate))


def inverse_gamma_pdf(x: Column, shape, scale) -> Column:
    a, b = lit(shape), lit(scale)
    return F.when(x > 0, F.exp(a * F.log(b) - (a + 1) * F.log(x) - b / x - log_gamma(a))).otherwise(0.0)


def beta_pdf(x: Column, a, b) -> Column:
    a, b = lit(a), lit(b)
    inside = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + (a - 1) * F.log(x) + (b - 1) * F.log1p(-x))
    return F.when((x > 0) & (x < 1), inside).otherwise(0.0)


def hypergeometric(m: Column, n: Column, big_m: Column, big_n: Column) -> Column:
    """ln of the chance of m marked items in n drawn, of M marked among N."""
    return log_choose(big_m, m) + log_choose(big_n - big_m, n - m) - log_choose(big_n, n)


def hypergeometric_tail(m: Column, n: Column, big_m: Column, big_n: Column) -> Column:
    """The chance of m or more marked items."""
    top = F.least(n, big_m)
    terms = F.when(m <= top, F.sequence(m.cast("long"), top.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + F.exp(hypergeometric(x, n, big_m, big_n))))


def akaike(lnl: Column, k: Column) -> Column:
    return 2 * k - 2 * lnl


def akaike_corrected(lnl: Column, n: Column, k: Column) -> Column:
    return akaike(lnl, k) + 2 * k * (k + 1) / (n - k - 1)


def bayesian(lnl: Column, n: Column, k: Column) -> Column:
    return k * F.log(n) - 2 * lnl


#: From these shapes on a density is integrated, whose peak is then narrow against its distance from 0 and, of a beta density, 1.
BY_INTEGRAL = 1000.0


def _stirling(z):
    """What ln gamma(z) has beyond (z - 1/2) ln z - z + ln(2 pi) / 2, for large z."""
    return 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)


def _gauss(f, low, high):
    """The integrals of f between arrays of bounds, by 80 points each."""
    import numpy as np

    at, weight = np.polynomial.legendre.leggauss(80)
    half = (high - low) / 2
    return (f(low[:, None] + half[:, None] * (at + 1)) * weight).sum(1) * half


def _gamma_inc_large(a, x):
    """The same for large a, by the integral of the density over the nearer tail; the density is written around its peak, where nothing cancels."""
    import numpy as np

    peak = a - 1
    wide = np.sqrt(a)
    top = np.exp(-0.5 * np.log(2 * np.pi * peak) - _stirling(peak))
    upper = x > peak
    far = np.where(upper, np.maximum(peak + 14 * wide, x + 8 * wide), np.maximum(0.0, np.minimum(peak - 14 * wide, x - 8 * wide)))

    def density(t):
        u = (t - peak[:, None]) / peak[:, None]
        with np.errstate(divide="ignore"):
            return np.exp(-peak[:, None] * (u - np.log1p(np.maximum(u, -1.0))))

    share = top * np.abs(_gauss(density, x, far))
    return np.clip(np.where(upper, 1 - share, share), 0.0, 1.0)


def _gamma_inc(a, x):
    """Lower incomplete gamma function over the complete one: the series below a + 1, the continued fraction above, an integral for large a."""
    import numpy as np

    a, x = np.asarray(a, float), np.asarray(x, float)
    out = np.where(x <= 0, np.where(np.isnan(x), np.nan, 0.0), np.where(np.isinf(x), 1.0, np.nan))
    plain = (x > 0) & np.isfinite(x) & np.isfinite(a)
    large, low, high = plain & (a >= BY_INTEGRAL), plain & (a < BY_INTEGRAL) & (x < a + 1), plain & (a < BY_INTEGRAL) & (x >= a + 1)
    out[large] = _gamma_inc_large(a[large], x[large])
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - np.array([math.lgamma(v) if v > 0 else np.nan for v in a]))
        p, q = a[low], x[low]
        term = total = 1 / p
        for i in range(1, 10_000):
            term = term * q / (p + i)
            total = total + term
            if not np.any(np.abs(term) > 1e-17 * np.abs(total)):
                break
        else:
            raise ArithmeticError("the series of an incomplete gamma function doesn't settle")
        out[low] = front[low] * total
        p, q = a[high], x[high]
        b, c = q + 1 - p, np.full_like(q, 1e300)
        d = 1 / b
        h = d
        for i in range(1, 10_000):
            k = -i * (i - p)
            b = b + 2
            d = k * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + k / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
            if not np.any(np.abs(d * c - 1) > 1e-15):
                break
        else:
            raise ArithmeticError("the fraction of an incomplete gamma function doesn't settle")
        out[high] = 1 - front[high] * h
    return out


def gamma_inc(a: Column, x: Column) -> Column:
    """Regularised lower incomplete gamma function."""

    @F.pandas_udf("double")
    def run(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series(_gamma_inc(p.to_numpy(float), q.to_numpy(float)))

    return run(a.cast("double"), x.cast("double"))


def erf(x: Column) -> Column:
    """Error function, from the incomplete gamma function of 1/2."""
    return F.signum(x) * gamma_inc(F.lit(0.5) + x * 0, x * x)


def chi_square_tail(chi2: Column, df: Column) -> Column:
    """The chance of a larger chi-square value."""
    return 1 - gamma_inc(df / 2, chi2 / 2)


def likelihood_ratio(null: Column, alt: Column, df: int, halved: bool = False) -> Column:
    """p-value of twice the difference of log likelihoods; halved where the tested parameter lies on its bound."""
    x = 2 * F.greatest(alt - null, F.lit(0.0))
    p = F.exp(-x / 2) if df == 2 else chi_square_tail(x, F.lit(float(df)) + x * 0)
    return p / 2 if halved else p


def cubic_roots(a: Column, b: Column, c: Column) -> Column:
    """The real roots of x^3 + a x^2 + b x + c, ascending; a multiple root is given once or as equal values."""
    q, r = (a * a - 3 * b) / 9, (2 * a * a * a - 9 * a * b + 27 * c) / 54
    inside = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r / F.sqrt(F.greatest(q * q * q, F.lit(5e-324)))))
    theta = F.acos(inside)
    three = F.array_sort(F.array(*(-2 * F.sqrt(F.greatest(q, F.lit(0.0))) * F.cos((theta + 2 * math.pi * k) / 3) - a / 3 for k in (0, 1, 2))))
    s = -F.signum(r) * F.cbrt(F.abs(r) + F.sqrt(F.greatest(r * r - q * q * q, F.lit(0.0))))
    one = F.array(s + F.when(s == 0, 0.0).otherwise(q / F.when(s == 0, 1.0).otherwise(s)) - a / 3)
    return F.when((r * r < q * q * q), three).otherwise(one)


def _beta_share_large(a: float, b: float, x: float) -> float:
    import numpy as np

    n = a + b
    mean, rest = a / n, b / n
    wide = math.sqrt(mean * rest / (n + 1))
    front = 0.5 * math.log(a) + 0.5 * math.log(b) - 0.5 * math.log(n) - 0.5 * math.log(2 * math.pi) + _stirling(n) - _stirling(a) - _stirling(b) - math.log(mean) - math.log(rest)
    upper = x > mean
    far = min(1.0, max(mean + 14 * wide, x + 8 * wide)) if upper else max(0.0, min(mean - 14 * wide, x - 8 * wide))

    def density(t):
        with np.errstate(divide="ignore"):
            return np.exp((a - 1) * np.log1p((t - mean) / mean) + (b - 1) * np.log1p((mean - t) / rest))

    share = math.exp(front) * abs(float(_gauss(density, np.array([x]), np.array([far]))[0]))
    return min(1.0, max(0.0, 1 - share if upper else share))


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction (Lentz's way of evaluating one), or for two large shapes by an integral."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if min(a, b) >= BY_INTEGRAL:
        return _beta_share_large(a, b, x)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    top, low, out = 1.0, 0.0, 1.0
    for i in range(1_000_000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        low = 1 / (1 + step * low or 1e-300)
        top = 1 + step / top or 1e-300
        out *= top * low
        if i and abs(top * low - 1) < 1e-15:
            break
    else:
        raise ArithmeticError("the fraction of an incomplete beta function doesn't settle")
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(front) * (out - 1) / a


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """The share of a beta distribution below x."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([_beta_share(*v) if all(c == c for c in v) else None for v in zip(a, b, x, strict=True)], dtype="float64")

    return run(lit(a), lit(b), lit(x))
